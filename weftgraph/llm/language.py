"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Each language has hashed counts of byte trigrams within words and of whole words. A word's script
narrows its candidate languages; its score for a candidate is the mean log-probability of its
trigrams plus that of the word itself. Viterbi then labels the words of a text, paying
``penalty`` for each switch, so passages in another language become spans of their own.

Most texts are of one language. The best single language's constant path is the optimum if no stretch of
words gains more than the penalty over it, nor the best beginning and the best end together (two stretches that meet
cost one switch only); this is tested with running minima, and only the other texts go through the dynamic
programme, all of a chunk in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import text_kernel as K
from weftgraph.llm.storage import lean_batches

BINS = 1 << 16
#: Lead bytes of UTF-8 by script. 0 has no letters, 1 Latin, 2 Greek, 3 Cyrillic, 4 Hebrew and Arabic,
#: 5 South and South-East Asian, 6 Kana and Han, 7 Hangul, 8 others.
_SCRIPT = np.zeros(256, np.uint8)
_SCRIPT[[*range(65, 91), *range(97, 123)]] = 1
_SCRIPT[0xC3:0xCA] = 1
_SCRIPT[0xCD:0xD0] = 2
_SCRIPT[0xD0:0xD5] = 3
_SCRIPT[0xD6:0xDC] = 4
_SCRIPT[0xE0] = 5
_SCRIPT[0xE3:0xEA] = 6
_SCRIPT[0xEA:0xEE] = 7
_SCRIPT[[0xCA, 0xD5, 0xDC, 0xDD, 0xDE, 0xDF, 0xE1, 0xE2, 0xEF, *range(0xF0, 0xF5)]] = 8
_SCRIPT[0xE2] = 0  # general punctuation, symbols
_SCRIPT[0xC2] = 0
SCRIPTS = 9
UNDETERMINED = "und"


class Model(NamedTuple):
    """Of bounded size: languages x (2 * BINS + SCRIPTS)."""

    languages: list[str]
    trigrams: np.ndarray  # log-probabilities, [BINS, languages]
    words: np.ndarray
    allowed: np.ndarray  # [SCRIPTS, languages]


class _Features(NamedTuple):
    words: K.Words
    gram: np.ndarray  # bin of each trigram
    gram_ptr: np.ndarray  # first trigram of each word
    word_bin: np.ndarray
    script: np.ndarray


def _features(buf: np.ndarray, offsets: np.ndarray) -> _Features:
    """Words are runs of letters and longer characters; a trigram is a byte with its neighbours in the word."""
    w = K.words(buf, offsets, K.NOT_LETTER)
    n = w.end - w.start
    ptr = np.append(0, np.cumsum(n))
    at = np.arange(ptr[-1]) + np.repeat(w.start - ptr[:-1], n)
    low = buf[at].astype(np.uint32)
    low[(low >= 65) & (low <= 90)] += 32
    left, right = np.empty_like(low), np.empty_like(low)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[ptr[:-1]] = 32
    right[ptr[1:] - 1] = 32
    gram = ((left * np.uint32(0x9E3779B1)) ^ (low * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    script = np.maximum.reduceat(_SCRIPT[buf[at]], ptr[:-1]) if len(n) else np.zeros(0, np.uint8)
    return _Features(w, (gram >> np.uint32(16)).astype(np.int64), ptr, (w.hash >> np.uint64(48)).astype(np.int64), script)


def _counts(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 2 * BINS + SCRIPTS), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, j, buf, offsets in K.chunks(batch.column(1)):
                f = _features(buf, offsets)
                of_word = np.repeat(lang[i:j], np.diff(f.words.ptr))
                of_gram = np.repeat(of_word, np.diff(f.gram_ptr))
                for x in range(len(languages)):
                    total[x, :BINS] += np.bincount(f.gram[of_gram == x], minlength=BINS)
                    total[x, BINS : 2 * BINS] += np.bincount(f.word_bin[of_word == x], minlength=BINS)
                    total[x, 2 * BINS :] += np.bincount(f.script[of_word == x], minlength=SCRIPTS)
        x, b = np.nonzero(total)
        yield pa.record_batch([pa.array(x.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[x, b])], ["lang", "bin", "n"])

    return run


def train(labelled: DataFrame, sample_rows: int = 20_000, max_languages: int = 200) -> Model:
    """Fit on about ``sample_rows`` rows of (doc_id, text, lang), chosen by a hash of doc_id; all of them if there are
    no more, so that no more than their features reach the driver. Rows with a null text or lang are left out; a
    table without others gives a model without languages. More than ``max_languages`` labels are an error."""
    lean_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null")
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(max_languages + 1).collect()
    if len(counted) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    share = min(1.0, sample_rows / max(1, sum(r["n"] for r in counted)))
    rows = rows.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    languages = [r["lang"] for r in counted]
    total = np.zeros((max(1, len(languages)), 2 * BINS + SCRIPTS))
    if languages:
        got = rows.select("lang", "text").mapInArrow(_counts(languages), "lang int, bin int, n long")
        got = got.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most languages x bins rows
        total[got["lang"], got["bin"]] = got["n"]
    log = lambda c, a: np.log((c + a) / (c.sum(1, keepdims=True) + a * BINS)).T.astype(np.float32)
    script = total[:, 2 * BINS :]
    allowed = (script > 0.001 * np.maximum(script.sum(1, keepdims=True), 1)).T
    allowed[~allowed.any(1)] = True  # a script that no language uses narrows nothing
    return Model(languages, log(total[:, :BINS], 0.05), log(total[:, BINS : 2 * BINS], 0.5), allowed)


def viterbi(scores: np.ndarray, ptr: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each row of ``scores`` [words, languages] on the best path of its text (rows ptr[i]:ptr[i+1]),
    where a change of label costs ``penalty``. Ties go to the first label."""
    n, m = scores.shape
    out = np.zeros(n, np.int64)
    if not n or m == 1:
        return out
    texts = np.flatnonzero(np.diff(ptr) > 0)
    sums = np.add.reduceat(scores, ptr[texts], axis=0)
    best = sums.argmax(1)
    length = np.diff(ptr)[texts]
    text = np.repeat(np.arange(len(texts)), length)
    first = np.append(0, np.cumsum(length))[:-1]
    one = np.ones(len(texts), bool)
    begins, ends = np.zeros(len(texts)), np.zeros(len(texts))
    for x in range(m):  # the largest gain of a stretch of words over the text's best language, anywhere and at either end
        gain = scores[:, x].astype(float) - scores[np.arange(n), best[text]]
        far = 2.0 * (np.abs(gain).sum() + 1)
        c = np.cumsum(gain) - text * far  # each text lies below all earlier ones, so minima don't cross
        before = np.concatenate([[0.0], c[:-1]])
        before[first] = c[first] - gain[first]
        low = np.minimum.accumulate(before)
        one &= np.maximum.reduceat(c - low, first) <= penalty
        np.maximum(begins, np.maximum.reduceat(c, first) - before[first], out=begins)
        np.maximum(ends, c[first + length - 1] - np.minimum.reduceat(before, first), out=ends)
    one &= begins + ends <= penalty
    out[:] = best[text]
    hard = np.flatnonzero(~one)
    if len(hard):
        hard = hard[np.argsort(-length[hard], kind="stable")]
        size = length[hard]
        start = ptr[texts[hard]]
        value = scores[start].astype(float)
        back = [np.zeros((0, m), np.int16)]
        for t in range(1, size[0]):
            live = int(np.searchsorted(-size, -t, "left"))  # the texts of more than t words
            v = value[:live]
            top = v.argmax(1)
            jump = v[np.arange(live), top][:, None] - penalty
            switch = jump > v
            back.append(np.where(switch, top[:, None], np.arange(m)).astype(np.int16))
            value[:live] = np.where(switch, jump, v) + scores[start[:live] + t]
        state = value.argmax(1)
        for t in range(size[0] - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            out[start[:live] + t] = state[:live]
            if t:
                state[:live] = back[t][np.arange(live), state[:live]]
    return out


def word_scores(f: _Features, model: Model) -> np.ndarray:
    """[words, candidates]; a language outside the word's script is far below the others."""
    m = len(model.languages)
    n = np.diff(f.gram_ptr)[:, None]
    if not len(n):
        return np.zeros((0, m), np.float32)
    # by column, which keeps temporary tables narrow
    s = np.stack([np.add.reduceat(model.trigrams[:, x][f.gram], f.gram_ptr[:-1]) for x in range(m)], 1) / n * np.minimum(n, 4)
    s += model.words[f.word_bin]
    s -= s.max(1, keepdims=True)
    np.maximum(s, -12.0, out=s)  # one odd word can't outweigh a text
    s[~model.allowed[f.script]] = -24.0
    s[f.script == 0] = 0
    return s


def _identify(model: Model, penalty: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.num_rows, len(model.languages)
            pred, score = np.full(n, -1), np.zeros(n)
            found: list[list[dict]] = [[] for _ in range(n)]
            letters = np.array(batch.column(2).fill_null(False))
            for i, j, buf, offsets in K.chunks(batch.column(1), 2 << 20):
                f = _features(buf, offsets)
                s = word_scores(f, model) if m else np.zeros((0, 0))
                if not m:
                    continue
                path = viterbi(s, f.words.ptr, penalty)
                weight = np.diff(f.gram_ptr) * (f.script > 0)
                text = np.repeat(np.arange(j - i), np.diff(f.words.ptr))
                share = np.bincount(text * m + path, weight, (j - i) * m).reshape(-1, m)
                total = share.sum(1)
                pred[i:j] = np.where(total > 0, share.argmax(1), 0)
                score[i:j] = np.where(total > 0, share.max(1) / np.maximum(total, 1), 1.0 / m)
                if spans and len(path):
                    new = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])))
                    for a, b in zip(new, np.append(new[1:], len(path)), strict=True):
                        found[i + text[a]].append({
                            "lang": model.languages[path[a]], "words": int(b - a),
                            "start": int(f.words.start[a] - offsets[text[a]]), "end": int(f.words.end[b - 1] - offsets[text[a]]),
                        })
            known = letters & (pred >= 0)
            names = [model.languages[p] if k else UNDETERMINED for p, k in zip(pred, known, strict=True)]
            cols = [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))]
            if spans:
                kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
                cols.append(pa.array(found, kind))
            yield pa.record_batch(cols, ["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score [, spans]: a row for each row of ``docs`` (doc_id, text).

    lang_pred is the language of most letters on the best path and score their share; ``und`` and 0 for a
    text that is null or has no letter, and for all if the model has no language. A text whose letters form no scored
    word, or a tie, goes to the first label. Rows that repeat are labelled each; other columns are ignored. Spans
    are byte ranges of the text with their language.
    """
    lean_batches(docs.sparkSession)
    raw = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"), raw.rlike(r"\p{L}").alias("letters"))
    kind = "doc_id long, lang_pred string, score double"
    if spans:
        kind += ", spans array<struct<lang: string, words: long, start: long, end: long>>"
    return texts.mapInArrow(_identify(model, penalty, spans), kind)

"""Token counts by a trie-shared dynamic programme, and a caching word encoder.

A unigram model gives each piece of a vocabulary a log-probability; the best split of a pre-token is
the one of the highest sum. Its forward scores depend on the prefix alone, so the distinct pre-tokens
of a chunk are inserted in a trie and every shared prefix is computed once; terminal nodes keep the
number of tokens, which each occurrence then looks up. The trie is built level by level in numpy: the
nodes of a level are the distinct (parent, byte) pairs. Where few words are left, their last stretch is a
branch without forks and is walked byte by byte. A process keeps the terminal counts of earlier chunks, in a
table of bounded size, so only words that are new to it enter a trie.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import text_kernel as K
from weftgraph.llm.storage import lean_batches

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
#: What a byte is in a word: 1 letter, 2 digit, 3 other printable; 0 asks for the tokenizer itself. Bytes of the letters of
#: Latin-1 and Latin Extended A and B count as letters; quotes (contractions) and < (special tokens) are 0.
_LETTER, _DIGIT = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA), *range(0x80, 0xC0)]] = _LETTER
_CLASS[[0x27, 0x3C]] = 0
#: Bytes as the characters that byte-level vocabularies write for them: printable ones stand for themselves.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_CHAR = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_OWN))}


#: What a cached run takes besides its ids: two Python objects and a place in the dictionary.
ENTRY_BYTES = 180


class TextEncoder:
    """Ids of whole texts by a ``tokenizers`` file of the lower-casing word-end kind, which joins no characters across
    white space. Words of simple characters are cut into runs of letters, digits and other signs in numpy;
    each distinct run goes to the file's BPE model once while it stays in a cache of bounded size. Any other
    word goes through the whole tokenizer. The ids equal those of encoding the whole text."""

    def __init__(self, path: str, cached_bytes: int = 24 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cached_bytes
        self.model, self.known, self.held = self.tokenizer.model, {}, 0

    def _run(self, raw: bytes) -> bytes:
        text = raw.decode().lower()
        if not text.isascii():
            text = "".join([_AS_CHAR[b] for b in text.encode()])
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin) of texts in one buffer."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _CLASS[buf]
        two = buf[1:].astype(np.uint16) | buf[:-1].astype(np.uint16) << 8
        kind[:-1][(two == 0xC397) | (two == 0xC3B7) | (two == 0xC4B0)] = 0  # signs among the letters; one that lower-cases to two
        solid = ~_BLANK[buf]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begin[inner] = solid[inner]
        word = np.cumsum(begin) - 1
        hard = np.zeros(int(word[-1]) + 1, bool)
        hard[word[solid & (kind == 0)]] = True
        cut = np.zeros(n, bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        if len(hard):
            cut &= solid & ~hard[np.maximum(word, 0)]
        begin |= cut
        start = np.flatnonzero(begin)
        stop = begin.copy()
        stop |= ~solid
        edges = np.append(np.flatnonzero(stop), n)
        end = edges[np.searchsorted(edges, start, "right")]
        ptr = np.searchsorted(start, offsets)
        special = hard[word[start]]
        key = K.range_hashes(buf, start, end)
        key[special] = np.arange(special.sum(), dtype=np.uint64)  # each its own: the case of special tokens counts
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        data, known, ids = buf.tobytes(), self.known, []
        for k, at in zip(distinct.tolist(), first.tolist(), strict=True):
            got = known.get(k)
            if got is None:
                raw = data[start[at] : end[at]]
                if special[at]:
                    ids.append(array("I", self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids).tobytes())
                    continue
                got = self._run(raw)
                if len(raw) <= 64:
                    known[k] = got
                    self.held += len(got) + ENTRY_BYTES
            ids.append(got)
        if self.held > self.limit:
            known.clear()
            self.held = 0
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, place = np.frombuffer(b"".join(ids), np.uint32), np.append(0, np.cumsum(size))[:-1]
        each = size[inverse]
        out = np.append(0, np.cumsum(each))
        return flat[np.repeat(place[inverse] - out[:-1], each) + np.arange(out[-1])], out[ptr]


_encoders: dict[str, TextEncoder] = {}


def shared_encoder(path: str) -> TextEncoder:
    """The process's encoder for a file: a worker that runs many tasks loads it once and keeps its cache."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


class UnigramVocabulary:
    """Pieces and log-probabilities from a sentencepiece file: pieces of its vocabulary (the word mark
    stripped), where the piece of rank r has the Zipf score ``-log(r + 1)``; a byte that no piece
    covers costs ``unknown`` and is a token of its own."""

    def __init__(self, path: str, unknown: float = -20.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        scores: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            piece = sp.id_to_piece(i).replace("▁", "").encode()
            if piece:
                scores.setdefault(piece, -float(np.log(i + 1)))
        self.scores, self.unknown, self.longest = scores, unknown, max(map(len, scores), default=1)
        keys = np.array([_piece_hash(p) for p in scores], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(scores.values(), float)[order]
        assert len(np.unique(keys)) == len(keys)
        self.known, self.known_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        bits = 22  # a table by the hash's top bits says which searches can be left out
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True

    def score(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -np.inf)
        at = np.flatnonzero(self.seen[h >> self.shift])
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[i] == h[at]
        out[at[hit]] = self.values[i[hit]]
        return out


_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(11).integers(1, 1 << 62, 256).astype(np.uint64)


def _piece_hash(piece: bytes) -> int:
    h = np.zeros(1, np.uint64)
    for b in piece:
        h = h * _STEP + _BYTES[b]
    return int(K.mix(h)[0])


#: So few words are walked byte by byte rather than level by level.
FEW = 256


def _walk(word: bytes, begin: int, score: list[float], tokens: list[int], vocabulary: UnigramVocabulary) -> int:
    """Tokens of the best split of ``word``, of which ``begin`` bytes are done; score and tokens: of the last places."""
    pieces, unknown, longest = vocabulary.scores, vocabulary.unknown, vocabulary.longest
    for i in range(begin + 1, len(word) + 1):
        best, count = score[-1] + unknown, tokens[-1] + 1
        for k in range(1, min(longest, i) + 1):
            s = pieces.get(word[i - k : i])
            if s is not None:
                s += score[-k]
                if s > best or s == best and tokens[-k] + 1 < count:
                    best, count = s, tokens[-k] + 1
        score.append(best)
        tokens.append(count)
        if len(score) > 4096:
            del score[:-longest], tokens[:-longest]
    return tokens[-1]


def trie_counts(buf: np.ndarray, start: np.ndarray, end: np.ndarray, vocabulary: UnigramVocabulary, few: int = FEW) -> np.ndarray:
    """Tokens of the best split of each pre-token buf[start:end] (distinct, not empty). Equal scores: fewer tokens."""
    n = len(start)
    counts, node = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # of the last levels: score, tokens, prefix hash and the parent of each node
    levels = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64))]
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(vocabulary.longest, _STEP)))
    alive, depth = np.arange(n), 0
    length = end - start
    while len(alive) > few:
        byte = buf[start[alive] + depth].astype(np.int64)
        keys, inverse = np.unique(node[alive] << 8 | byte, return_inverse=True)
        parent, byte = keys >> 8, (keys & 255).astype(np.uint8)
        prefix = levels[-1][2][parent] * _STEP + _BYTES[byte]
        best = levels[-1][0][parent] + vocabulary.unknown
        tokens = levels[-1][1][parent] + 1
        up = parent
        for k in range(1, min(vocabulary.longest, depth + 1) + 1):
            score, count, hashes, parents = levels[-k]
            s = vocabulary.score(K.mix(prefix - hashes[up] * powers[k])) + score[up]
            c = count[up] + 1
            better = (s > best) | ((s == best) & (c < tokens))
            best[better], tokens[better] = s[better], c[better]
            up = parents[up]
        levels = [*levels[-vocabulary.longest :], (best, tokens, prefix, parent)]
        node[alive] = inverse
        depth += 1
        done = length[alive] == depth
        counts[alive[done]] = tokens[inverse[done]]
        alive = alive[~done]
    for i in alive.tolist():
        score, tokens, at = [], [], node[i]
        for level in reversed(levels):
            score.append(float(level[0][at]))
            tokens.append(int(level[1][at]))
            at = level[3][at]
        counts[i] = _walk(buf[start[i] : end[i]].tobytes(), depth, score[::-1], tokens[::-1], vocabulary)
    return counts


_vocabularies: dict[str, UnigramVocabulary] = {}


def shared_vocabulary(path: str) -> UnigramVocabulary:
    """The process's vocabulary for a file, with the counts of the words that it has seen."""
    if path not in _vocabularies:
        _vocabularies[path] = UnigramVocabulary(path)
    return _vocabularies[path]


def word_counts(buf: np.ndarray, w: K.Words, vocabulary: UnigramVocabulary, cached: int = 1 << 20) -> np.ndarray:
    """Tokens of each word; of the distinct ones, those that ``vocabulary`` hasn't met go through a trie. Up to ``cached``
    words (16 bytes each) stay known."""
    hashes, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    counts = np.zeros(len(hashes), np.int64)
    i = np.searchsorted(vocabulary.known, hashes)
    new = np.ones(len(hashes), bool)
    if len(vocabulary.known):
        i = np.minimum(i, len(vocabulary.known) - 1)
        new = vocabulary.known[i] != hashes
        counts[~new] = vocabulary.known_counts[i[~new]]
    if new.any():
        counts[new] = trie_counts(buf, w.start[first[new]], w.end[first[new]], vocabulary)
        keep = len(vocabulary.known) + new.sum() <= cached  # else begin anew
        known = np.concatenate([vocabulary.known, hashes[new]]) if keep else hashes
        found = np.concatenate([vocabulary.known_counts, counts[new]]) if keep else counts
        order = np.argsort(known, kind="stable")
        vocabulary.known, vocabulary.known_counts = known[order], found[order]
    return counts[inverse]


def _count(path: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared_vocabulary(path)
        for batch in batches:
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, buf, offsets in K.chunks(batch.column(1), chunk_bytes):
                low = _LOWER[buf]
                w = K.words(low, offsets)
                if not len(w.hash):
                    continue
                sums = np.append(0, np.cumsum(word_counts(low, w, vocabulary)))
                n_words[i:j], n_tokens[i:j] = np.diff(w.ptr), sums[w.ptr[1:]] - sums[w.ptr[:-1]]
            yield pa.record_batch([batch.column(0), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"])

    return run


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def count_tokens(docs: DataFrame, vocabulary_path: str, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_tokens: a row for each row of ``docs``.

    Pre-tokens are runs of bytes other than ASCII white space, A-Z taken as a-z; n_tokens is the number of
    pieces of their best splits. Null, empty and blank texts have none. Rows that repeat are counted each.
    Nothing is shuffled, and work and memory follow the bytes of a text, whatever the length of its words.
    """
    lean_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_count(vocabulary_path, chunk_bytes), "doc_id long, n_words long, n_tokens long")

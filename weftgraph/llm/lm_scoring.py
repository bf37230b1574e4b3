"""Cross-entropy difference of two matched bigram models.

Every distinct word and word pair of all documents is counted exactly. Texts are dealt by hash into blocks
of about ``BLOCK_BYTES``. A block sends the counts of its distinct words and pairs, a message for each bucket
of their hashes; a bucket adds them up and sends back what each block asked for. So no task holds more than
a block or a bucket, the driver only gets sums, and a frequent pair is one entry a block. Background counts
are scaled to the target's total, so both models have as much evidence and the same smoothing. A document's
score is the mean over its tokens of log P_target - log P_background.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import text_kernel as K
from weftgraph.llm.storage import lean_batches, materialise

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Up to so many target ids (8 bytes each) are broadcast; beyond it documents are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Keys of pairs and of a text's begin are odd, those of words even.
_BEGIN = np.uint64(0x5DEECE66D1234567)
_LANE = np.uint64(0x9E3779B97F4A7C15)


class Models(NamedTuple):
    """counts: block, bucket, data: the sums over all documents of what a block asked for, in the order of its keys."""

    counts: DataFrame
    blocks: int
    words: int  # distinct ones
    totals: tuple[int, int]  # tokens: target, all
    scale: float  # of the background's counts
    prior: float


class Block(NamedTuple):
    """Tokens of a block's texts. Items are its distinct words, then the begin of a text, then its distinct pairs."""

    n: np.ndarray  # tokens of each text
    text: np.ndarray  # of each token
    now: np.ndarray  # items of each token
    before: np.ndarray
    pair: np.ndarray
    last: np.ndarray  # tokens that end a text
    begin: int  # item
    keys: np.ndarray  # of the items, sorted
    order: np.ndarray  # items by key


def _block(texts: pa.Array | pa.ChunkedArray) -> Block:
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, buf, offsets in K.chunks(texts):
        w = K.words(buf, offsets)
        hashes.append(w.hash)
        sizes.append(np.diff(w.ptr))
    n = np.concatenate(sizes)
    words, now = np.unique(np.concatenate(hashes), return_inverse=True)
    v = len(words)
    ends = np.cumsum(n)[n > 0]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[ends - n[n > 0]] = v
    code, pair = np.unique(before * (v + 1) + now, return_inverse=True)
    with_begin = np.append(words, _BEGIN)
    pairs = K.mix(with_begin[code // (v + 1)] * _LANE + words[code % (v + 1)]) | np.uint64(1)
    keys = np.concatenate([words & ~np.uint64(1), [_BEGIN], pairs])
    order = np.argsort(keys, kind="stable")
    return Block(n, np.repeat(np.arange(len(n)), n), now, before, pair + v + 1, ends - 1, v, keys[order], order)


def _pack(x: np.ndarray) -> bytes:
    """Counts as byte planes, without the high ones that are zero; the others compress well in a shuffle."""
    width = max(1, (int(x.view(np.uint64).max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x, "<i8").reshape(-1).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").reshape(4, -1)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys of a bucket: the first, and the gaps between them, which have few high bytes."""
    return keys[:1].tobytes() + _pack(np.diff(keys).view(np.int64))


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(data[8], -1)
    out = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    out[0] = np.frombuffer(data, np.uint8, 8)
    out[1:, : data[8]] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """All rows of a key, whose tasks are dealt by key."""
    found = [b for b in batches if b.num_rows]
    if found:
        table = pa.Table.from_batches(found)
        keys = table[key].to_numpy()
        for k in np.unique(keys).tolist():
            yield k, table if len(keys) == (keys == k).sum() else table.filter(pa.array(keys == k))


def _ask(bits: int):
    """The counts of a block's keys: in all, in target documents, at the end of a text, at that of a target document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _whole(batches, "block"):
            b = _block(table["text"])
            member = table["target"].to_numpy().astype(bool)
            size, hot = len(b.keys), member[b.text]
            counts = np.zeros((4, size), np.int64)
            for at in (b.now, b.pair):
                counts[0] += np.bincount(at, minlength=size)
                counts[1] += np.bincount(at[hot], minlength=size)
            counts[2] = np.bincount(b.now[b.last], minlength=size)
            counts[3] = np.bincount(b.now[b.last[hot[b.last]]], minlength=size)
            counts[:2, b.begin] = len(b.last), hot[b.last].sum()
            counts = counts[:, b.order]
            bucket = (b.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(size, np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
            rows = [(int(bucket[i]), block, _pack_keys(b.keys[i:j]), _pack(counts[:, i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.record_batch(cols, ["bucket", "block", "keys", "counts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by key for each block that asked, and a row of block -1: distinct words, tokens, target tokens."""
    names = ["block", "bucket", "data", "words", "n", "target"]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    for bucket, table in _whole(batches, "bucket"):
        parts = [_unpack_keys(x) for x in table["keys"].to_pylist()]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros((4, len(keys)), np.int64)
        bounds = np.cumsum([0, *map(len, parts)])
        for lo, hi, data in zip(bounds[:-1], bounds[1:], table["counts"].to_pylist(), strict=True):
            for k, x in enumerate(_unpack(data)):
                np.add.at(total[k], at[lo:hi], x)
        word = keys & np.uint64(1) == 0
        rows = [(-1, bucket, b"", int(word.sum()), int(total[0, word].sum()), int(total[1, word].sum()))]
        for block, lo, hi in zip(table["block"].to_pylist(), bounds[:-1], bounds[1:], strict=True):
            rows.append((block, bucket, _pack(total[:, at[lo:hi]]), 0, 0, 0))
            if len(rows) == 500:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def train(docs: DataFrame, target_ids: DataFrame, vocabulary_size: int | None = None, bins: int | None = None, prior: float = 50.0) -> Models:
    """Both models from docs (doc_id, text); the target documents are those in ``target_ids`` (doc_id).
    All documents, words and pairs count. vocabulary_size and bins, once the model's size, bound nothing
    any more and are accepted for callers that still pass them."""
    rows = _with_target(docs, target_ids)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = (-(-size // BUCKET_BYTES) - 1).bit_length() if size else 0
    asked = _dealt(rows, blocks).repartitionById(blocks, "block").mapInArrow(_ask(bits), "bucket int, block int, keys binary, counts binary")
    counts = asked.repartitionById(1 << bits, "bucket").mapInArrow(_answer, "block int, bucket int, data binary, words long, n long, target long")
    counts = materialise(counts, "counts")
    sums = counts.where("block < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n", "target")])
    words, all_n, all_target = sums.first()
    scale = all_target / all_n if all_n else 1.0
    return Models(counts.where("block >= 0").select("block", "bucket", "data"), blocks, words, (all_target, all_n), scale, prior)


def _own(text: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """How often each token's key occurs in its own text."""
    _, at, n = np.unique(text * size + key, return_inverse=True, return_counts=True)
    return n[at]


def _score(words: int, totals: tuple[int, int], scale: float, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _whole(batches, "block"):
            is_text = pc.is_null(table["bucket"])
            found = table.filter(pc.invert(is_text)).sort_by("bucket")["data"].to_pylist()
            rows = table.filter(is_text)
            b = _block(rows["text"])
            size, n = len(b.keys), b.n
            sums = np.concatenate([_unpack(x) for x in found], axis=1) if found else np.zeros((4, 0), np.int64)
            if sums.shape[1] != size:
                raise ValueError("the models were trained on other documents")
            counts = np.empty_like(sums)
            counts[:, b.order] = sums
            member = rows["target"].to_numpy().astype(bool)
            mine = [_own(b.text, key, size) for key in (b.now, b.before, b.pair)]
            loss = np.zeros((2, len(n)))
            for k, part in enumerate((np.where(member, 1.0, 0.0), np.full(len(n), scale))):
                by = counts[1 - k] * (scale if k else 1.0)
                context = by - counts[3 - k] * (scale if k else 1.0)
                out = part[b.text]  # a text's own counts don't speak for it
                one = np.maximum(by[b.now] - out * mine[0], 0) + 0.5
                one /= np.maximum(totals[k] * (scale if k else 1.0) - part * n, 0)[b.text] + 0.5 * words
                c = np.maximum(context[b.before] - out * mine[1], 0)
                pair = np.clip(by[b.pair] - out * mine[2], 0, c)
                loss[k] = np.bincount(b.text, -np.log((pair + prior * one) / (c + prior)), len(n))
            mean = loss / np.maximum(n, 1)
            cols = [pa.array(x, mask=n == 0) for x in (mean[0], mean[1], mean[1] - mean[0])]
            ids = rows["doc_id"].combine_chunks()
            yield pa.record_batch([ids, pa.array(n), *cols], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def _with_target(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    lean_batches(docs.sparkSession)
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left")
    return joined.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks).cast("long")).cast("int"))


def score(docs: DataFrame, target_ids: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score: a row for each row of ``docs``, which the models
    were trained on; nats a token. Each text is scored without its own counts. A larger score is more like
    the target. Null, empty and blank texts have 0 tokens and null losses."""
    texts = _dealt(_with_target(docs, target_ids), models.blocks)
    texts = texts.select("block", "doc_id", "target", "text", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("data"))
    rows = texts.unionByName(models.counts, allowMissingColumns=True).repartitionById(models.blocks, "block")
    run = _score(models.words, models.totals, models.scale, models.prior)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")

"""Pattern packing by non-negative least squares.

Documents are tokenized once; only the pieces' lengths, places and checksums go on. The histogram of
piece lengths (at most ``capacity`` bins, whatever the corpus) decides the plan: patterns of one to
three lengths that fill a sequence exactly are enumerated, non-negative least squares fits how often
each repeats so that the patterns' lengths add up to the histogram, the counts are rounded down, and
what remains is packed best-fit. The plan is a table of runs (length, ranks from-to -> sequence,
offset); its size depends on the number of patterns, not on the corpus. Pieces of a length are
numbered in parallel and look their place up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import text_kernel as K
from weftgraph.llm.storage import lean_batches, materialise
from weftgraph.llm.tokens import shared_encoder

Pattern = tuple[int, ...]


def _pieces(tokenizer_path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = shared_encoder(tokenizer_path), np.array([end_id], np.uint32)
        for batch in batches:
            for i, j, buf, offsets in K.chunks(batch.column(1), 1 << 20):
                flat, ptr = encode(buf, offsets)
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for row in range(j - i):
                    a = np.concatenate([flat[ptr[row] : ptr[row + 1]], end]).astype("<u4", copy=False)
                    for p, lo in enumerate(range(0, len(a), capacity)):
                        part = a[lo : lo + capacity]
                        doc.append(i + row)
                        piece.append(p)
                        start.append(lo)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.tobytes())
                cols = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.record_batch(cols, names)

    return run


def enumerate_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, limit: int) -> list[Pattern]:
    """Patterns of one to three present lengths that fill ``capacity`` exactly; of the triples, evenly
    spread over the largest lengths, as many as ``limit`` allows. Triples beyond it are only left out of the fit:
    every piece that no pattern takes is packed by ``residual``."""
    have = np.zeros(capacity + 1, np.int64)
    have[lengths] = counts
    out: list[Pattern] = [(capacity,)] if have[capacity] else []
    out += [(a, capacity - a) for a in range(capacity - 1, (capacity - 1) // 2, -1) if have[a] and have[capacity - a] and (2 * a > capacity or have[a] > 1 and 2 * a == capacity)]
    present = [int(x) for x in lengths if x < capacity]
    each = max(1, (limit - len(out)) // max(1, len(present)))
    for a in reversed(present):
        rest = capacity - a
        b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
        b = b[(have[b] > 0) & (have[rest - b] > 0)] if len(b) else b
        if len(b) > each:  # those whose lengths are most frequent
            b = b[np.argsort(-np.minimum(have[b], have[rest - b]), kind="stable")[:each]]
        out += [(a, int(x), int(rest - x)) for x in b]
    return out


def nnls(patterns: list[Pattern], target: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that brings sum of x * lengths of the patterns close to ``target`` (counts by length) in
    squared error: accelerated projected gradient on the sparse matrix."""
    if not patterns:
        return np.zeros(0)
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.fromiter((n for p in patterns for n in p), np.int64)
    weight = 1.0 / np.maximum(np.bincount(row, minlength=len(target)), 1)  # balances lengths that few patterns use
    n = len(patterns)
    apply = lambda x: np.bincount(row, x[col], len(target))
    back = lambda r: np.bincount(col, (r * weight)[row], n)
    x = np.zeros(n)
    v = np.random.default_rng(0).random(n)
    for _ in range(20):
        v = back(apply(v))
        bound = np.linalg.norm(v)
        v /= bound
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(apply(y) - target) / (1.05 * bound))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: dict[int, int], capacity: int, pattern_limit: int = 60_000) -> list[tuple[Pattern, int]]:
    """(lengths of a sequence, how many such sequences), covering the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    lengths = np.flatnonzero(left)
    patterns = enumerate_patterns(lengths, left[lengths], capacity, pattern_limit)
    fit = np.floor(nnls(patterns, left.astype(float))).astype(np.int64)
    out: list[tuple[Pattern, int]] = []
    for i in np.argsort(-fit, kind="stable"):
        need = np.bincount(patterns[i], minlength=capacity + 1)
        n = int(min(fit[i], (left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left -= n * need
            out.append((patterns[i], n))
    return out + residual(left, capacity)


def residual(left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: equal pieces go together into equally full sequences, so the work
    follows the number of different lengths and fillings, not the number of pieces."""
    spaces: list[int] = []  # free places of open sequences, sorted
    groups: dict[int, list[list]] = {}  # free -> [lengths, how many]
    full: list[tuple[Pattern, int]] = []

    def put(free: int, lengths: Pattern, n: int) -> None:
        if not n:
            return
        if not free:
            full.append((lengths, n))
            return
        if free not in groups:
            groups[free] = []
            insort(spaces, free)
        groups[free].append([lengths, n])

    for size in np.flatnonzero(left)[::-1]:
        size, count = int(size), int(left[size])
        while count:
            i = bisect_left(spaces, size)
            if i == len(spaces):
                each = min(count, capacity // size)  # a new sequence takes as many of this length as fit
                n = count // each
                put(capacity - each * size, (size,) * each, n)
                count -= each * n
                continue
            free = spaces[i]
            lengths, n = groups[free].pop()
            if not groups[free]:
                del groups[free]
                spaces.pop(i)
            each = min(free // size, count)
            took = min(n, count // each)
            put(free, lengths, n - took)
            put(free - each * size, lengths + (size,) * each, took)
            count -= each * took
    return full + [(tuple(p), n) for g in groups.values() for p, n in g]


def _runs(sequences: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of a length is in the last run
    that begins at or before it, in sequence first + (r - first rank)."""
    used: dict[int, int] = {}
    rows, at = [], 0
    for lengths, n in sequences:
        offset = 0
        for size in lengths:
            rows.append((size, used.get(size, 0), at, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        at += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(runs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(runs[:, 0], np.arange(runs[-1, 0] + 2)) if len(runs) else np.zeros(1, np.int64)
        key = runs[:, 0].astype(np.float64) * 2.0**40 + runs[:, 1] if len(runs) else np.zeros(0)
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, n.astype(np.float64) * 2.0**40 + r, "right") - 1
            assert (runs[i, 0] == n).all() and (i >= first[n]).all()
            keep = [b.column(c) for c in b.schema.names if c not in ("rank",)]
            names = [c for c in b.schema.names if c not in ("rank",)]
            yield pa.record_batch([*keep, pa.array(runs[i, 2] + r - runs[i, 1]), pa.array(runs[i, 3])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, rows_per_salt: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids]: a row for each piece.

    A document's tokens are the tokenizer's ids of its text (null: empty) and ``end_id``; only documents of
    more than ``capacity`` tokens are cut. Every piece is in one sequence; the pieces of a sequence lie at
    gapless offsets from 0 and have at most ``capacity`` tokens together. Repeated rows are packed as often
    as they occur. An empty table gives no rows.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    lean_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(texts.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), kind), "pieces")
    counted = pieces.groupBy("length").agg(F.count("*").alias("n"))
    runs = _runs(plan({r["length"]: r["n"] for r in counted.collect()}, capacity))  # at most ``capacity`` rows

    # numbers within a length: by a salt, so that a frequent length is many groups
    salts = max(8, -(-pieces.count() // rows_per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    by_salt = by_salt.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start"))
    ranked = salted.withColumn("inside", inside).join(by_salt, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(_place(runs), f"{kind}, sequence_id long, offset long")

"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

A window that is similar enough to an item has some of its shingles, so only windows that contain an
item's shingle are fingerprinted; this skips nothing that could match. Fingerprints of windows are
looked up in a multi-index: 256 bits in 16 blocks of 16. Of two fingerprints within 63 bits, at least 4
blocks differ by 4 bits or fewer (else 13 blocks would differ by 65 bits in all), so the items that are near in
4 blocks hold all items within the radius; of unrelated items that is one in some hundred. Candidates are
verified by the exact weighted (multiset) similarity of shingles.

Of windows at a similarity of 0.8, about one in 100,000 has a fingerprint further than 63 bits
from the item's; equal windows are always found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import text_kernel as K
from weftgraph.llm.storage import lean_batches

BITS, BLOCKS = 256, 16
_LANES = np.random.default_rng(23).integers(1, 1 << 62, BITS // 64).astype(np.uint64)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """[n, BLOCKS] blocks of 16 bits from sums of +1/-1 by bit: [n, BITS]."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _bits(h: np.ndarray) -> np.ndarray:
    """+1/-1 by bit of each hash: [n, BITS]."""
    lanes = K.mix(h[:, None] ^ _LANES)
    return np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1).astype(np.int32) * 2 - 1


@cache
def near_blocks(radius: int) -> tuple[int, int]:
    """(bits, blocks): fingerprints within ``radius`` have at least so many blocks within so many bits. Of all such
    pairs, the one that fewest unrelated fingerprints fulfil."""
    best = None
    for bits in range(17):
        blocks = BLOCKS - radius // (bits + 1)  # so many can't differ by more
        if blocks > 0:
            p = sum(comb(16, i) for i in range(bits + 1)) / 2**16
            chance = sum(comb(BLOCKS, i) * p**i * (1 - p) ** (BLOCKS - i) for i in range(blocks, BLOCKS + 1))
            best = min(best or (2.0, 0, 0), (chance, bits, blocks))
    return best[1:]


class Index:
    """Items by length in words, with the blocks of their fingerprints and their shingles."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int, radius: int) -> None:
        self.shingle, self.radius, self.ids = shingle, radius, ids
        self.size, self.bag, prints, posts = [], [], [], []
        for n, (_, _, buf, offsets) in enumerate(K.chunks(pa.array(texts, pa.string()), 0)):
            w = K.words(buf, offsets, K.NOT_ALNUM)
            h, _ = K.shingles(w, max(1, min(shingle, len(w.hash))))  # a short item is one shingle of its own length
            values, counts = np.unique(h, return_counts=True)
            self.size.append(len(w.hash))
            self.bag.append(dict(zip(values.tolist(), counts.tolist(), strict=True)))
            prints.append(fingerprints(_bits(h).sum(0, keepdims=True))[0])
            posts.append(np.stack([values, np.full(len(values), n, np.uint64)], 1))
        self.prints = np.array(prints, np.uint16).reshape(-1, BLOCKS)
        posts = np.concatenate(posts) if posts else np.zeros((0, 2), np.uint64)
        posts = posts[np.argsort(posts[:, 0], kind="stable")]
        self.shingles, first = np.unique(posts[:, 0], return_index=True)
        self.post_ptr, self.post = np.append(first, len(posts)), posts[:, 1].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.shingles >> np.uint64(44)] = True
        self.of_length = {n: np.flatnonzero(np.array(self.size) == n) for n in set(self.size)}
        self.short = sorted({n for n in self.size if 0 < n < shingle})
        #: A whole text that is shorter than the item can lie further off at the same similarity (4 of 5 shingles: 19 % of the bits).
        self.short_radius = radius + BITS // 20
        self.columns = {n: np.ascontiguousarray(self.prints[items].T) for n, items in self.of_length.items()}
        self.compared = self.candidates = 0

    def lookup(self, length: int, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
        """(row of ``prints``, item) of all items of the length within the radius."""
        columns, items, out = self.columns[length], self.of_length[length], []
        bits, blocks = near_blocks(radius)
        step = max(1, (1 << 21) // len(items))
        for lo in range(0, len(prints), step):
            part = prints[lo : lo + step]
            near = np.zeros((len(part), len(items)), np.uint8)
            for b in range(BLOCKS):
                near += np.bitwise_count(part[:, b, None] ^ columns[b]) <= bits
            row, found = np.nonzero(near >= blocks)
            far = np.bitwise_count(part[row] ^ columns[:, found].T).sum(1, dtype=np.int64)
            self.compared, self.candidates = self.compared + near.size, self.candidates + len(row)
            within = far <= radius
            out += zip((row[within] + lo).tolist(), items[found[within]].tolist(), strict=True)
        return out


def _similarity(window: np.ndarray, bag: dict[int, int]) -> float:
    values, counts = np.unique(window, return_counts=True)
    both = sum(min(c, bag.get(v, 0)) for v, c in zip(values.tolist(), counts.tolist(), strict=True))
    return both / (len(window) + sum(bag.values()) - both)


#: Windows that are fingerprinted at once, a kilobyte each.
_REGION = 2048


def _matches(h: np.ndarray, n_words: int, index: Index, hits: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
    """item -> (similarity, first word) of the best window of one text; ``h``: its shingles in order."""
    k, best = index.shingle, {}
    at = np.searchsorted(index.shingles, h[hits])
    by_length: dict[int, list[int]] = {}
    for p, s in zip(hits.tolist(), at.tolist(), strict=True):
        for n in {index.size[i] for i in index.post[index.post_ptr[s] : index.post_ptr[s + 1]]}:
            by_length.setdefault(n, []).append(p)
    for n, places in by_length.items():
        if n < k and n_words >= k:
            continue  # exact, in _short
        span = max(1, min(n, n_words) - k + 1)  # shingles of a window
        last = len(h) - span
        p = np.array(places)
        starts = np.unique(np.maximum(0, np.minimum(last, (p[:, None] - np.arange(span)[None, :]).ravel())))
        for piece in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):  # windows that overlap, together
            for part in np.split(piece, range(_REGION, len(piece), _REGION)):
                lo, hi = int(part[0]), int(part[-1]) + span
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(h[lo:hi]), 0)])
                prints = fingerprints(sums[part - lo + span] - sums[part - lo])
                for row, item in index.lookup(n, prints, index.radius if n_words >= n else index.short_radius):
                    start = int(part[row])
                    s = _similarity(h[start : start + span], index.bag[item])
                    if s >= threshold and s > best.get(item, (0, 0))[0]:
                        best[item] = (s, start)
    return best


def _scan(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float, int]] = []
            for i, j, buf, offsets in K.chunks(batch.column(1)):
                w = K.words(buf, offsets, K.NOT_ALNUM)
                counts = np.diff(w.ptr)
                for k in [*index.short, index.shingle]:
                    h, ptr = K.shingles(w, k)
                    hit = np.flatnonzero(index.maybe[h >> np.uint64(44)])
                    hit = hit[index.shingles[np.minimum(np.searchsorted(index.shingles, h[hit]), len(index.shingles) - 1)] == h[hit]]
                    text = np.searchsorted(ptr, hit, "right") - 1
                    for r in np.unique(text):
                        own = hit[text == r] - ptr[r] if len(hit) < 50 else hit[np.searchsorted(text, r) : np.searchsorted(text, r, "right")] - ptr[r]
                        mine = h[ptr[r] : ptr[r + 1]]
                        if k < index.shingle:  # items of fewer words than a shingle: equal or not
                            found = {}
                            for p in own.tolist():
                                s = int(np.searchsorted(index.shingles, mine[p]))
                                for item in index.post[index.post_ptr[s] : index.post_ptr[s + 1]].tolist():
                                    if index.size[item] == k:
                                        found.setdefault(item, (1.0, p))
                        else:
                            found = _matches(mine, int(counts[r]), index, own, threshold)
                        out += [(i + int(r), index.ids[item], s, start) for item, (s, start) in found.items()]
            out = list({(r, item): (r, item, s, start) for r, item, s, start in out}.values())
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(rows), *(pa.array([x[c] for x in out], kind) for c, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64())))],
                ["doc_id", "item_id", "similarity", "first_word"],
            )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 63, block_rows: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, similarity, first_word: the best window of each document for each item it contains.

    Words are runs of ASCII letters, digits and longer characters, A-Z taken as a-z. A window has as many words as
    the item, or is the whole text where that is shorter; its similarity is the sum of the smaller counts over
    the sum of the larger counts of shingles of ``shingle`` words. An item of fewer words matches its exact
    sequence. Null, empty and wordless texts and items match nothing; a null doc_id stays null and rows of
    a null item_id are left out. Rows that repeat a doc_id are matched each; of equal windows the first counts.
    The index goes to the tasks, about ``block_rows`` items and ``block_bytes`` bytes of their texts at a time:
    documents are scanned once for each such block.
    """
    lean_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, item_id long, similarity double, first_word long"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null")
    held = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-held["n"] // block_rows), -(-held["bytes"] // block_bytes))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # a block
        index = Index([r["item_id"] for r in rows], [r["text"] for r in rows], shingle, radius)
        if not len(index.shingles):
            continue
        found = texts.mapInArrow(_scan(index, threshold), kind)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], kind)

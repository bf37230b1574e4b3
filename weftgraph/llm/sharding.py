"""Sharding by sampled splitters.

Equal texts are a group, and groups lie on one scale of bytes in the order of their hashes. Splitters are
quantiles of a sample in which a record's chance grows with its size; they range-partition the records by
hash, and ranges that turn out overfull get splitters from a denser sample of their own. Groups that are large
in bytes or rows (of which there are few) have ranges of their own, cut further by a random key, so that no
task holds a large group.

Large groups are put first, best fit, each into one shard; only a group for which no shard has room is
divided. The other groups then fill the room that is left, in the order of the scale and undivided.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from weftgraph.llm.storage import materialise, release

_LEAST = -(1 << 63)
_MAX_CUTS = 20


class Layout(NamedTuple):
    """Where the scale is cut: a place p belongs to ``shard[i]`` of the last ``begin[i] <= p``."""

    begin: np.ndarray
    shard: np.ndarray
    segment: dict[int, float]  # where each large group begins, by hash


def arrange(total: int, shards: int, large: list[tuple[int, int]]) -> Layout:
    """Cuts for a scale that has all small groups from 0 on and then each of the ``large`` (hash, bytes)."""
    target = max(total, 1) / shards
    room = [target] * shards
    small = total - sum(n for _, n in large)
    pieces, segment, at = [], {}, float(small)
    for h, n in sorted(large, key=lambda x: (-x[1], x[0])):
        segment[h], begin, left = at, at, float(n)
        fits = [(r, s) for s, r in enumerate(room) if r >= left]
        if fits:
            _, s = min(fits)
            room[s] -= left
            pieces.append((begin, s))
        else:
            while left > 1e-6:  # as few shards as can be
                s = int(np.argmax(room))
                take = min(room[s], left) if room[s] > 1e-6 else left
                room[s] -= take
                left -= take
                pieces.append((begin, s))
                begin += take
        at += n
    begin = 0.0
    for s, r in enumerate(room):
        if r > 0:
            pieces.append((begin, s))
            begin += r
    pieces.sort(key=lambda x: x[0])
    return Layout(np.array([p for p, _ in pieces]), np.array([s for _, s in pieces], np.int32), segment)


def _draw(meta: DataFrame, wanted: float, weight: float, seed: int) -> list[tuple[int, int]]:
    """Sorted (h, d) of about ``wanted`` of records that weigh ``weight``, whatever their number."""
    unit = F.shiftrightunsigned(F.xxhash64("d", "h", F.lit(seed)), 11) / float(1 << 53)
    rows = meta.where(unit < F.col("weight") * (wanted / weight)).select("h", "d").collect()
    return sorted((r.h, r.d) for r in rows)


def _at_or_below(bounds: list[str], value: Column) -> Column:
    """How many of the sorted ``bounds`` (SQL literals) are at or below a value: a binary search in the JVM, as Python
    workers would take more of an executor's memory than the rows do."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    known, steps = F.expr(f"array({', '.join(bounds)})"), [1 << i for i in reversed(range(n.bit_length()))]

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= n) & (F.get(known, at + by - 1) <= value), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _range(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters (h, d) at or below a record."""
    return _at_or_below([f"named_struct('h', {h}L, 'd', {d}L)" for h, d in splitters], F.struct("h", "d"))


def _shard(layout: Layout, place: Column) -> Column:
    """The shard of a place of the scale."""
    piece = _at_or_below([f"CAST('{float(b)!r}' AS DOUBLE)" for b in layout.begin], place)
    return F.get(F.expr(f"array({', '.join(str(int(s)) for s in layout.shard)})"), F.greatest(piece - 1, F.lit(0)))


def _cut(meta: DataFrame, large: list[int], ranges: int, samples_per_range: int, seed: int) -> tuple[DataFrame, list[int | None]]:
    """Rows with their range, none of which is overfull, and the large group that each range belongs to."""
    sample = _draw(meta, ranges * samples_per_range, 1.0, seed)
    edges = {x for h in large for x in ((h, _LEAST), (h + 1, _LEAST)) if x[0] < 1 << 63}
    whole = set(large)
    splitters = edges
    for again in range(_MAX_CUTS):
        picked = {sample[len(sample) * i // ranges] for i in range(1, ranges)} if sample else set()
        splitters = sorted({*splitters, *((h, d if h in whole else _LEAST) for h, d in picked)})
        placed = meta.withColumn("range", _range(splitters))
        filled = placed.groupBy("range").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
        filled = filled.where((F.col("w") > 4 / ranges) & (F.col("n") > 1)).collect()  # a record can't be divided
        if not filled:
            break
        over = sum(r["w"] for r in filled)
        sample = _draw(placed.where(F.col("range").isin(sorted(r["range"] for r in filled))), ranges * samples_per_range, over, seed + 1 + again)
    else:
        raise RuntimeError(f"ranges stay overfull after {_MAX_CUTS} rounds of splitters")
    owner = [None, *(h if h in whole else None for h, _ in splitters)]
    return placed, owner


def shard(
    docs: DataFrame, shards: int = 8, rows_per_range: int = 200_000, samples_per_range: int = 32, large_share: float = 0.01, seed: int = 17
) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null): a row for each row of ``docs``.

    size: UTF-8 bytes of the text plus 1; a null text has size 1 and a null checksum, an empty one size 1
    and checksum 0. Null texts are a group. A group of equal texts is in one shard, unless it is larger than what any
    shard has room for when its turn comes. slot runs from 0 without gaps in each shard. Rows that repeat
    doc_id and text get different slots. Shards differ by less than ``large_share`` of a shard, but for single
    rows that are larger. Ranges hold about ``rows_per_range`` rows, or what a 256th of the table weighs.
    """
    raw = F.col("text").cast("string")
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw, F.lit(seed)).alias("h"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("d"),  # written once: equal rows differ, too
    )
    meta = materialise(meta, "sizes")
    first = meta.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, n = first["bytes"] or 0, first["rows"]
    groups = meta.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    most = large_share / shards  # of all bytes or rows: so there are fewer than 2 / most large groups
    large: list[Row] = groups.where((F.col("bytes") > most * total) | (F.col("rows") > max(most * n, 1))).collect()
    layout = arrange(total, shards, [(g["h"], g["bytes"]) for g in large])
    weighed = meta.withColumn("weight", F.col("size") / (2.0 * max(total, 1)) + 1 / (2.0 * max(n, 1)))
    placed, owner = _cut(weighed, [g["h"] for g in large], max(256, -(-n // rows_per_range)), samples_per_range, seed)
    placed = materialise(placed.drop("weight"), "placed")

    spark = docs.sparkSession
    at, small, rows = dict(layout.segment), 0.0, []
    for r, size in sorted((r["range"], r["s"]) for r in placed.groupBy("range").agg(F.sum("size").alias("s")).collect()):  # one row a range
        if owner[r] is None:
            rows.append((r, small, False))
            small += size
        else:
            rows.append((r, float(at[owner[r]]), True))
            at[owner[r]] += size
    base = F.broadcast(spark.createDataFrame(rows, "range int, base double, large boolean"))  # bounded by the ranges
    in_order = Window.partitionBy("range").orderBy("h", "d")
    same = Window.partitionBy("range", "h")
    scale = placed.join(base, "range").withColumn("begin", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    inside = F.when(F.col("large"), F.col("begin") + F.col("size") / 2).otherwise(F.min("begin").over(same) + F.sum("size").over(same) / 2)
    scale = scale.withColumn("shard", _shard(layout, F.col("base") + inside))
    scale = materialise(scale.select("doc_id", "size", "text_crc32", "h", "d", "range", "shard"), "sharded")
    release(meta, placed)

    first_slot: dict[int, int] = {}
    rows = []
    for s, r, k in sorted((r["shard"], r["range"], r["n"]) for r in scale.groupBy("range", "shard").agg(F.count("*").alias("n")).collect()):
        rows.append((r, s, first_slot.get(s, 0)))
        first_slot[s] = first_slot.get(s, 0) + k
    base = F.broadcast(spark.createDataFrame(rows, "range int, shard int, first long"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("range", "shard").orderBy("h", "d")) - 1
    return scale.join(base, ["range", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, placement: DataFrame, path: str) -> None:
    """Write the rows of ``docs`` as Parquet folders shard=0, 1, ... (doc_id must be unique)."""
    docs.join(placement.select("doc_id", "shard", "slot"), "doc_id").repartition("shard", F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").parquet(path)

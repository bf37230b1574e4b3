"""Embedding near-duplicates by NN-descent.

Equal vectors are one class. A neighbour graph starts from random-hyperplane cells and is refined by
joining each vector's neighbours and reverse neighbours with one another (neighbours of neighbours)
until few entries change. Edges over the threshold give components. A list whose every entry is over
the threshold is saturated: it can't hold all links. The lists of such vectors are enlarged to twice the length
and descend again, spent on neighbours from other components only, and so on until no list is
saturated; a link with any other vector is in that vector's list. The links inside a component are counted by
exact double-precision cosine of all its members, in pairs of blocks, whatever its size. A bounded set of audit queries is
compared with all vectors in blocks; links that the graph missed are added, and below ``recall`` more cells and
rounds follow. A recall that stays under ``least_recall`` is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.groups import components, join_counted, whole_groups
from weftgraph.llm.storage import materialise, release

_SLACK = 2e-3  # of cosines of half-precision vectors, which the graph is built from


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, in double and in half precision; null for vectors that link with nothing."""
    for batch in batches:
        column, n = batch.column(1), batch.num_rows
        flat = column.flatten()  # leaves out what null rows may hold
        size = np.diff(column.offsets.to_numpy()) * ~column.is_null().to_numpy(zero_copy_only=False)
        x = flat.to_numpy(zero_copy_only=False).astype(float)
        first = np.append(0, np.cumsum(size))[:-1]
        good = np.zeros(n, bool)
        some = np.flatnonzero(size)
        if len(some):
            top = np.maximum.reduceat(np.abs(x), first[some])  # nan and inf come through; a null is nan
            good[some] = np.isfinite(top) & (top > 0)
        out, half = [None] * n, [None] * n
        for r in np.flatnonzero(good).tolist():
            a = x[first[r] : first[r] + size[r]]
            a = a / np.abs(a).max()
            a /= np.sqrt((a * a).sum())
            out[r], half[r] = a.tobytes(), a.astype(np.float16).tobytes()
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), pa.array(half, pa.binary())], ["vec_id", "unit", "half"])


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """[len(x), len(y)]: whether the cosine of unit vectors reaches the threshold. Sums that rounding could decide are
    taken again without it, so every pair has one answer, whatever block it is met in."""
    near = x @ y.T
    out = near >= threshold
    for i, j in zip(*np.nonzero(np.abs(near - threshold) < 1e-12), strict=True):
        out[i, j] = math.fsum(x[i] * y[j]) >= threshold
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _half(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _codes(tables: int, planes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("id"), np.array([len(x.as_buffer()) for x in batch.column("half")])
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                x = _half(batch.column("half").take(at))
                normal = np.random.default_rng([seed, int(size)]).standard_normal((x.shape[1], tables * planes)).astype(np.float32)
                signs = (x @ normal > 0).reshape(len(x), tables, planes)
                code = (signs << np.arange(planes)).sum(2) + (np.arange(tables) << 40) + (int(size) << 46)
                yield pa.record_batch(
                    [pa.array(np.repeat(ids.take(at).to_numpy(), tables)), pa.array(code.ravel().astype(np.int64))], ["id", "cell"]
                )

    return run


def _nearest(k: int):
    """The k nearest of each vector within its cell's chunk, of other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["cell", "chunk"]):
            ids, component, u, v, s = table["id"].to_numpy(), table["component"].to_numpy(), [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                x = _half(table["half"].slice(lo, hi - lo))
                sim = x @ x.T
                sim[component[lo:hi, None] == component[None, lo:hi]] = -2
                n = min(k, hi - lo - 1)
                top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(sim, top, 1).ravel()
                other = near > -2
                u.append(np.repeat(ids[lo:hi], n)[other])
                v.append(ids[lo + top].ravel()[other])
                s.append(near[other])
            if u:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (u, v, s)], ["u", "v", "sim"])

    return run


def _local_join(k: int):
    """Pairs of two components among the neighbours of a vector that would enter one of their lists, if either is new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["u"]):
            ids, worst, fresh = table["v"].to_numpy(), table["worst"].to_numpy(), table["fresh"].to_numpy(zero_copy_only=False).astype(bool)
            component = table["component"].to_numpy()
            x = _half(table["half"])
            a, b, s = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = x[lo:hi]
                sim = part @ part.T
                take = (sim > worst[lo:hi][:, None]) & (fresh[lo:hi][:, None] | fresh[lo:hi][None, :])
                take &= component[lo:hi, None] != component[None, lo:hi]
                i, j = np.nonzero(take)
                a.append(ids[lo + i])
                b.append(ids[lo + j])
                s.append(sim[i, j])
            yield pa.record_batch([pa.array(np.concatenate(y)) for y in (a, b, s)], ["u", "v", "sim"])

    return run


def _exact_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column("ua")), _matrix(batch.column("ub"))
                ok = np.array([linked(x[i : i + 1], y[i : i + 1], threshold)[0, 0] for i in range(len(x))])
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _degrees(threshold: float, rows: int = 1024):
    """Links of the asking members (block) with the others (block2) of a pair of blocks of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["component", "block", "block2"]):
            ids, asks, copies = table["id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False), table["copies"].to_numpy()
            out_id, out_n = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                x, a = _matrix(table["unit"].slice(lo, hi - lo)), asks[lo:hi].astype(bool)
                left, right = np.flatnonzero(a), np.flatnonzero(~a)
                for i in range(0, len(left), rows):
                    at = left[i : i + rows]
                    n = np.zeros(len(at), np.int64)
                    for j in range(0, len(right), rows):
                        to = right[j : j + rows]
                        near = linked(x[at], x[to], threshold) & (ids[lo + at][:, None] != ids[lo + to][None, :])
                        n += near @ copies[lo + to]
                    out_id.append(ids[lo + at])
                    out_n.append(n)
            if out_id:
                yield pa.record_batch([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_n))], ["id", "n"])

    return run


def _audit(ids: np.ndarray, units: list[bytes], component: np.ndarray, threshold: float):
    """Links of the audit queries: how many, how many within the query's component, and the others."""
    by_size = {n: np.array([i for i, x in enumerate(units) if len(x) == n]) for n in {len(x) for x in units}}
    matrix = {n: np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), -1) for n, at in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = found = 0
        missed: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) for x in batch.column("unit")])
            for n in np.unique(sizes):
                if n not in matrix:
                    continue
                rows = np.flatnonzero(sizes == n)
                part = batch.take(pa.array(rows))
                x, own, comp = _matrix(part.column("unit")), part.column("id").to_numpy(), part.column("component").to_numpy()
                for lo in range(0, len(x), 2048):
                    q, r = np.nonzero(linked(matrix[n], x[lo : lo + 2048], threshold))
                    q, r = by_size[n][q], r + lo
                    q, r = q[ids[q] != own[r]], r[ids[q] != own[r]]
                    same = component[q] == comp[r]
                    total, found = total + len(q), found + int(same.sum())
                    for a, b, c in zip(ids[q[~same]].tolist(), own[r[~same]].tolist(), comp[r[~same]].tolist(), strict=True):
                        missed.setdefault((a, c), (a, b))
        rows = [(-1, -1, total, found), *((a, b, 0, 0) for a, b in missed.values())]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["a", "b", "total", "found"])

    return run


def near_duplicates(
    table: DataFrame,
    threshold: float = 0.9,
    neighbours: int = 10,
    tables: int = 4,
    cell_rows: int = 256,
    max_rounds: int = 6,
    settled: float = 0.01,
    recall: float = 0.99,
    least_recall: float = 0.9,
    max_restarts: int = 3,
    audit_queries: int = 1000,
    block_rows: int = 4096,
) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall: a row for each row of ``table`` (vec_id, embedding).

    Vectors that are null, empty or zero or hold null or non-finite components have no links, nor do vectors of
    different lengths. Rows of equal vectors are linked with one another, also if they repeat a vec_id. Rows of a
    null vec_id with a valid vector are left out of all links and have kept = false. audit_recall is the share of
    the audit queries' links whose ends the graph had joined into one component, before the missed ones were
    added; it is null if they have none. A ValueError says that it stayed below ``least_recall``.
    """
    raw = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    raw = materialise(raw.mapInArrow(_vectors, "vec_id long, unit binary, half binary"), "vectors")
    valid = raw.where("unit is not null and vec_id is not null")
    vecs = materialise(valid.groupBy("unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.min("half").alias("half")), "classes")
    n = vecs.count()
    by_sim = lambda key: Window.partitionBy(key).orderBy(F.desc("sim"), F.col("v") if key == "u" else F.col("u"))

    def best(edges: DataFrame, k: int) -> DataFrame:
        """The nearest of each vector; an entry that was there before is not fresh."""
        one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        return one.withColumn("r", F.row_number().over(by_sim("u"))).where(F.col("r") <= k).drop("r")

    def descend(points: DataFrame, k: int, seed: int, graph: DataFrame | None = None) -> DataFrame:
        """u, v, sim, fresh: lists of the k nearest of other components, for points (id, half, component)."""
        m = points.count()
        planes = max(0, int(np.ceil(np.log2(max(1, m / cell_rows)))))
        cells = points.select("id", "half").mapInArrow(_codes(tables, planes, seed), "id long, cell long")
        cells = materialise(cells, "cells")
        filled = materialise(cells.groupBy("cell").agg(F.count("*").alias("m")), "filled")
        chunk = F.pmod(F.xxhash64("id", "cell", F.lit(seed)), F.ceil(F.col("m") / (4 * cell_rows)))  # each table cuts a full cell anew
        dealt = join_counted(cells, filled, "cell", "m", tables * m).withColumn("chunk", chunk).join(points, "id")
        dealt = dealt.select("cell", "chunk", "id", "half", "component").repartition("cell", "chunk").sortWithinPartitions("cell", "chunk")
        seeds = dealt.mapInArrow(_nearest(k), "u long, v long, sim float").withColumn("fresh", F.lit(True))
        graph = materialise(best(seeds if graph is None else seeds.unionByName(graph), k), "graph")
        release(cells, filled)
        for _ in range(max_rounds):
            worst = graph.groupBy("u").agg(F.when(F.count("*") < k, -2.0).otherwise(F.min("sim")).cast("float").alias("worst"))
            back = graph.withColumn("r", F.row_number().over(by_sim("v"))).where(F.col("r") <= k)
            near = graph.select("u", "v", "fresh").union(back.select(F.col("v"), F.col("u"), F.col("fresh")))
            near = near.groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
            info = points.select(F.col("id").alias("v"), "half", "component").join(worst.withColumnRenamed("u", "v"), "v", "left")
            info = info.withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
            around = near.join(info, "v").select("u", "v", "fresh", "worst", "half", "component").repartition("u").sortWithinPartitions("u")
            better = around.mapInArrow(_local_join(k), "u long, v long, sim float").withColumn("fresh", F.lit(True))
            old = graph.withColumn("fresh", F.lit(False))
            nxt = materialise(best(old.unionByName(better), k), "graph")
            release(graph)
            graph = nxt
            if graph.where("fresh").count() <= settled * k * m:
                break
        return graph

    def confirmed(graph: DataFrame) -> DataFrame:
        """a < b: the edges over the threshold; those that half precision can't tell by the exact cosine."""
        edges = graph.where(F.col("sim") >= threshold - _SLACK)
        edges = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
        unsure = edges.where(F.col("sim") < threshold + _SLACK)
        units = lambda c, x: vecs.select(F.col("id").alias(c), F.col("unit").alias(x))
        unsure = unsure.join(units("a", "ua"), "a").join(units("b", "ub"), "b").select("a", "b", "ua", "ub")
        return edges.where(F.col("sim") >= threshold + _SLACK).select("a", "b").union(unsure.mapInArrow(_exact_pairs(threshold), "a long, b long"))

    def label(links: DataFrame) -> DataFrame:
        groups = components(links).withColumnRenamed("node", "id")
        named = vecs.select("id", "unit", "copies").join(groups, "id", "left")
        return materialise(named.withColumn("component", F.coalesce("component", "id")), "labelled")

    def full_lists(lists: DataFrame, k: int) -> DataFrame:
        """Vectors whose list of k holds nothing but links."""
        full = lists.groupBy("u").agg(F.count("*").alias("m"), F.min("sim").alias("worst"))
        return full.where((F.col("m") >= k) & (F.col("worst") >= threshold - _SLACK)).select(F.col("u").alias("id"))

    graph, rate = None, None
    everything = vecs.select("id", "half", F.col("id").alias("component"))
    for start in range(max_restarts):
        graph = descend(everything, neighbours, start, graph)
        links = materialise(confirmed(graph).distinct(), "links")
        labelled = label(links)
        saturated = materialise(full_lists(graph, neighbours), "saturated")
        full, k = saturated, neighbours
        for phase in count(1):  # a link that a list of links only can't hold leads to another component or is counted below
            points = materialise(labelled.select("id", "component").join(full, "id").join(vecs.select("id", "half"), "id"), "enlarged")
            if points.select("component").distinct().limit(2).count() < 2:
                release(points)
                break
            k = 2 * k
            lists = descend(points, k, start + 1000 * phase)
            full = full_lists(lists, k)
            more = materialise(confirmed(lists), "links")
            if more.limit(1).count():
                release(labelled)
                merged = materialise(links.union(more).distinct(), "links")
                release(links)
                links = merged
                labelled = label(links)
            release(points, more)

        chance = F.shiftrightunsigned(F.xxhash64(F.lit("audit"), "id"), 11) / float(1 << 53)
        asked = labelled.where(chance < audit_queries / max(1, n)).select("id", "unit", "component").collect()
        if not asked:
            break
        test = _audit(np.array([r["id"] for r in asked]), [bytes(r["unit"]) for r in asked], np.array([r["component"] for r in asked]), threshold)
        seen = labelled.select("id", "unit", "component").mapInArrow(test, "a long, b long, total long, found long")
        seen = materialise(seen, "audit")
        total, found = seen.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
        rate = found / total if total else None
        if total > found:  # what the queries found besides
            release(labelled)
            links = links.union(seen.where("a >= 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
            labelled = label(links)
        if rate is None or rate >= recall:
            break
        if start < max_restarts - 1:
            release(labelled, saturated)
        elif rate < least_recall:
            raise ValueError(f"the neighbour graph joins only {rate:.3f} of the audited links")
    if not n:
        return raw.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(None).cast("double").alias("audit_recall"))

    sizes = labelled.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / block_rows), F.least(F.lit(8), F.ceil(F.col("m") / 128)))  # dealt to a few tasks in any case
    sizes = materialise(sizes.select("component", "m", blocks.cast("int").alias("blocks")), "sizes")
    members = join_counted(labelled, sizes, "component", "m", n)
    members = materialise(members.select("component", "blocks", "id", "copies", "unit"), "members")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = members.withColumn("asks", F.lit(True)).withColumn("block", own).withColumn("block2", each)
    asked = members.withColumn("asks", F.lit(False)).withColumn("block2", own).withColumn("block", each)
    keep = ["component", "block", "block2", "asks", "id", "copies", "unit"]
    spread = asking.select(*keep).unionByName(asked.select(*keep)).repartition("component", "block", "block2").sortWithinPartitions("component", "block", "block2")
    counted = spread.mapInArrow(_degrees(threshold), "id long, n long")
    degrees = counted.groupBy("id").agg(F.sum("n").alias("n"))
    named = labelled.join(degrees, "id", "left").select("unit", "component", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    named = materialise(named, "named")
    release(sizes, members)
    found = join_counted(valid.select("vec_id", "unit"), named, "unit", "copies", raw.count()).select("vec_id", "n", "component")
    alone = raw.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    kept = F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False))
    out = found.unionByName(alone)
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"), F.lit(rate).cast("double").alias("audit_recall"))

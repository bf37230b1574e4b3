"""Grouped Arrow streams and connected components, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.storage import materialise, release

#: Of the rows of a table: hits(x, others) says which of the others (row numbers) row x is linked with.
Kernel = Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups from batches that come sorted by ``keys`` (integers, not null), and the
    bounds of the groups. Only the group at a batch's end waits for the next batch."""
    rest: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return table, np.append(np.flatnonzero(new), table.num_rows)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        here = tuple(batch.column(k)[0].as_py() for k in keys), tuple(batch.column(k)[-1].as_py() for k in keys)
        if last is not None and here == (last, last):
            rest.append(batch)
            continue
        table, bounds = cut([*rest, batch])
        rest, last = table.slice(bounds[-2]).to_batches(), here[1]
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
    if rest:
        yield cut(rest)


#: A key with more than one in so many rows is hot; there are fewer than so many such keys, whatever the table.
HOT = 256
_FEW_ROWS = 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted`` on ``key``, where counted has each key once, ``n`` is at least the number of
    rows of the key and ``total`` at least the sum of n. Hot keys, which a shuffle would send to one task each, are
    fewer than HOT and are broadcast; all others are joined by a shuffle. Both frames are read twice."""
    is_hot = F.col(n) > max(_FEW_ROWS, total // HOT)
    hot = F.broadcast(counted.where(is_hot))
    cold = rows.join(F.broadcast(counted.where(is_hot).select(key)), key, "left_anti").join(counted.where(~is_hot), key)
    joined = rows.join(hot, key)
    return joined.unionByName(cold.select(*joined.columns))


def trees(n: int, hits: Callable[[int, np.ndarray], np.ndarray], label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) pairs of a spanning forest of the nodes 0..n-1: stars around the first node of each tree.
    hits(x, others) says which of the others x is linked with; a node is asked about those only that nothing has
    reached yet. Nodes of equal ``label`` count as linked."""
    free = np.arange(n)
    roots, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(free):
        root = int(free[0])
        free, stack = free[1:], [root]
        while stack and len(free):
            x = stack.pop()
            if label is None:
                hit = hits(x, free)
            else:
                hit = label[free] == label[x]
                hit[~hit] = hits(x, free[~hit])
            if hit.any():
                found, free = free[hit], free[~hit]
                roots.append(np.full(len(found), root))
                nodes.append(found)
                stack += found.tolist()
    return np.concatenate(roots), np.concatenate(nodes)


def _links_of(kernel: Kernel):
    """Stars of the forests of groups of rows, as pairs of different labels; a row that comes twice (as a member and as
    a hub) counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["group", "block", "chunk"]):
            ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
            a, b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                at = lo + np.flatnonzero(np.append(True, ids[lo + 1 : hi] != ids[lo : hi - 1]))
                if len(at) < 2:
                    continue
                root, node = (labels[at[x]] for x in trees(len(at), kernel(table.take(pa.array(at))), labels[at]))
                _, one = np.unique(node, return_index=True)
                one = one[root[one] != node[one]]
                a.append(root[one])
                b.append(node[one])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


#: Columns that linked_groups adds to its rows.
_ADDED = {"label", "rest", "share", "own", "block", "chunk", "chunks", "component", "main", "in_main", "in_group"}


def linked_groups(rows: DataFrame, kernel: Kernel, max_rounds: int = 4) -> DataFrame:
    """(node, component) by the links within groups: ``rows`` has group, id (long, once in a group), m (rows of the group),
    blocks (into how many its size cuts it) and what ``kernel`` needs. kernel(table) gives hits(x, others) for the
    rows of a table, whose columns may have any name but those of _ADDED. No link between the rows of a group is missed.

    A group of one block is one task's work. The rows of a larger group meet within their block, and with hubs:
    about a block's worth of sampled rows that every block gets a copy of. That leaves few components in a group of
    near copies. As long as a group has several, the rows outside its largest one, the rest, give the next
    hubs; if all of them fit into a block, that round is the group's last. A rest that ``max_rounds`` don't bring
    down to a block meets all blocks of its group, in pieces. Rows of groups that hang together so are copied a
    few times at most, however large the group is.
    """
    if taken := _ADDED.intersection(rows.columns):
        raise ValueError(f"columns of linked_groups itself: {sorted(taken)}")
    blank = rows.withColumns({"label": F.col("id"), "rest": F.lit(True), "share": 1.0 / F.col("blocks")})
    payload = [c for c in rows.columns if c not in ("group", "id", "m", "blocks")]

    def meet(state: DataFrame, salt: int, last: bool) -> DataFrame:
        keep = ["group", "block", "chunk", "id", "label", *payload]
        chunks = F.when(F.col("share") >= 1, 1).otherwise(F.ceil(1 / F.col("share"))).cast("int") if last else F.lit(1)
        state = state.withColumns({"chunks": chunks, "own": F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")).cast("int")})
        members = state.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("block", F.col("own"))
        unit = F.shiftrightunsigned(F.xxhash64(F.lit("hub"), "id", F.lit(salt)), 11) / float(1 << 53)
        piece = F.floor(unit * F.col("chunks")).cast("int") if last else F.lit(0)
        hubs = state.where("rest and blocks > 1")
        hubs = hubs if last else hubs.where((F.col("share") >= 1) | (unit < F.col("share")))
        hubs = hubs.withColumn("chunk", piece).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = members.select(*keep).unionByName(hubs.select(*keep))
        dealt = dealt.repartition("group", "block", "chunk").sortWithinPartitions("group", "block", "chunk", "id")
        return materialise(dealt.mapInArrow(_links_of(kernel), "a long, b long"), "met")

    found = meet(blank, 0, False)
    labels = components(found)
    release(found)
    large = rows.where("blocks > 1")
    if not large.limit(1).count():
        return labels
    for salt in range(1, max_rounds + 1):
        own = large.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        own = materialise(own, "state")
        sizes = own.groupBy("group", "label").agg(F.count("*").alias("k"))
        sizes = sizes.groupBy("group").agg(F.max_by("label", "k").alias("main"), F.max("k").alias("in_main"), F.sum("k").alias("in_group"))
        sizes = materialise(sizes.where("in_main < in_group"), "open")  # of the groups that are cut into blocks
        state = None
        if sizes.limit(1).count():
            state = join_counted(own, sizes, "group", "in_group", own.count())
            state = state.withColumns({"rest": F.col("label") != F.col("main"), "share": F.col("m") / ((F.col("in_group") - F.col("in_main")) * F.col("blocks"))})
            more = meet(state, salt, salt == max_rounds)
            labels = _merged(labels, more)
            release(more)
            large = materialise(state.where("share < 1").select(*rows.columns), "large")
        release(own, sizes)
        if state is None or salt == max_rounds or not large.limit(1).count():
            return labels
    return labels


#: Up to so many merged labels (16 bytes each) are broadcast; beyond it all labels are computed anew.
_BROADCAST_LABELS = 500_000


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after links between components, or nodes that had none."""
    merged = components(links)
    n = merged.count()
    if not n:
        return labels
    if n > _BROADCAST_LABELS:
        return components(links.union(labels.select("node", "component")))
    to = F.broadcast(merged.select(F.col("node").alias("component"), F.col("component").alias("to")))
    out = labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialise(out.unionByName(merged.join(labels.select("node"), "node", "left_anti")), "merged")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, in pieces of bounded size, as stars around the least node of what hangs together."""
    held, n = [], 0

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        names, ends = np.unique(np.concatenate([table[0].to_numpy(), table[1].to_numpy()]), return_inverse=True)
        a, b = np.split(ends, 2)
        low = np.arange(len(names))
        while True:
            least = np.minimum(low[a], low[b])
            new = low.copy()
            np.minimum.at(new, low[a], least)
            np.minimum.at(new, low[b], least)
            while (new[new] != new).any():
                new = new[new]
            if (new == low).all():
                break
            low = new
        at = np.flatnonzero(low != np.arange(len(names)))
        return pa.record_batch([pa.array(names[at]), pa.array(names[low[at]])], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n > 1 << 20:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each end of ``edges`` (two columns of long).

    Each partition first contracts its own edges. Then large-star and small-star steps alternate: every round is a
    grouped minimum and a join, links never reach the driver, and the number of rounds follows the logarithm of the
    longest path. Nodes with
    very many links don't gather in a task (see join_counted). Null ends and loops are ignored; nodes
    without a link to another node aren't returned.
    """
    a, b = edges.columns[:2]
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))  # neither is null
    e = materialise(e.mapInArrow(_contracted, "u long, v long").distinct(), "links")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("smaller"))
        low = materialise(low, "nodes")
        if not low.where("smaller > 0 and n > 1").limit(1).count():
            break  # every node points at its root
        total = 2 * e.count()
        large = join_counted(e.withColumnsRenamed({"u": "far", "v": "u"}), low.select("u", "m", "n"), "u", "n", total)
        large = materialise(large.select(F.col("far").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(e, low, large)
        e = nxt
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    release(e)
    return low.select(F.col("u").alias("node"), F.col("m").alias("component"))

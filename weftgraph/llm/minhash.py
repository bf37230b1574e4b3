"""MinHash near-duplicate detection by an inverted join over signature coordinates.

1. One pass over the texts makes each document's set of word shingles, its size, a 64-bit hash of
   the set and a signature of minima. Documents of equal sets are one class from then on.
2. Classes are posted under their (coordinate, value) pairs. A pair of classes that agrees in
   ``min_matches`` of ``coordinates`` places must share one of the rarest
   ``coordinates - min_matches + 1`` pairs of each (prefix filter), so only those are posted; pairs
   that a single class has are skipped altogether.
3. Each list is merged in numpy by whole signatures: members whose set sizes can't reach the
   similarity are skipped, matching coordinates are counted. A list gives the spanning forest of its
   candidate graph, fewer pairs than it has members. The forests' components hold every candidate pair.
4. The full sets of a component meet; exact intersection sizes confirm the links, of which again a
   spanning forest goes on. Long lists and large components are cut into blocks, which meet by way of hubs
   (see groups.linked_groups). So no group ever emits all its pairs, and no link between different texts is lost.

At a similarity of 0.8, a pair fails to agree in 14 of 32 places with a probability of about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import text_kernel as K
from weftgraph.llm.groups import join_counted, linked_groups
from weftgraph.llm.storage import lean_batches, materialise, release

#: Set this many ids at most are broadcast (8 bytes each); beyond it ids are joined by a shuffle.
BROADCAST_IDS = 500_000


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(1).integers(1, 1 << 62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _set_key(part: np.ndarray) -> np.uint64:
    """A hash of a set of shingles (sorted, distinct) and its size."""
    return K.mix(K.mix(part).sum(keepdims=True) + np.uint64(len(part)))[0]


def _signatures(shingle: int, coordinates: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _multipliers(coordinates)
        for batch in batches:
            n = batch.num_rows
            size, key = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            sig = np.zeros((n, coordinates), np.uint32)
            for i, j, buf, offsets in K.chunks(batch.column("text")):
                h, ptr = K.shingles(K.words(buf, offsets), shingle)
                full = np.flatnonzero(np.diff(ptr) > 0)
                if not len(full):
                    continue
                for c in range(coordinates):
                    sig[i + full, c] = np.minimum.reduceat(h * a[c], ptr[:-1][full]) >> np.uint64(32)
                for r in full:
                    part = h[ptr[r] : ptr[r + 1]]
                    part.sort()
                    part = part[np.append(True, part[1:] != part[:-1])] if len(part) > 1 else part
                    size[i + r], key[i + r] = len(part), _set_key(part)
            cols = [batch.column("doc_id"), pa.array(size), pa.array(key.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())]
            yield pa.record_batch([*cols, *map(batch.column, carry)], ["doc_id", "n_shingles", "node", "sig", *carry])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each coordinate of each signature."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
        k = sig.shape[1]
        token = K.mix(sig.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32)))
        for lo in range(0, batch.num_rows, 4096):
            part = token[lo : lo + 4096]
            ids = np.repeat(batch.column("id").to_numpy()[lo : lo + 4096], k)
            yield pa.record_batch([pa.array(ids), pa.array(part.ravel().view(np.int64))], ["id", "token"])


def _candidates(min_matches: int, percent: int):
    """Whether the sizes of two classes allow the similarity and enough of their coordinates agree."""

    def kernel(table: pa.Table):
        size = table["n"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(len(size), -1)

        def hits(x: int, others: np.ndarray) -> np.ndarray:
            near = (size[others] * 100 >= size[x] * percent) & (size[others] * percent <= size[x] * 100)
            near[near] = (sig[others[near]] == sig[x]).sum(1) >= min_matches
            return near

        return hits

    return kernel


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in K.chunks(batch.column(1)):
                h, ptr = K.shingles(K.words(buf, offsets), shingle)
                sets = [np.unique(h[ptr[r] : ptr[r + 1]]) for r in range(j - i)]
                keys = np.array([_set_key(x) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(keys), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "set"])

    return run


def intersections(sets: list[np.ndarray], cells: int = 1 << 23) -> np.ndarray:
    """[n, n] sizes of the intersections of sets (sorted, distinct)."""
    n, columns = len(sets), max(256, cells // max(1, len(sets)))
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    keep = shared[inverse]
    row, col = row[keep], number[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)  # exact up to 2**24 shared shingles
    for c in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(col, [c, c + columns])
        m = np.zeros((n, min(columns, int(shared.sum()) - c)), np.float32)
        m[row[lo:hi], col[lo:hi] - c] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def _links(percent: int):
    """Whether the sets of two classes have the similarity."""

    def kernel(table: pa.Table):
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        size, both = np.array([len(x) for x in sets], np.int64), intersections(sets)

        def hits(x: int, others: np.ndarray) -> np.ndarray:
            shared = both[x, others].astype(np.int64)
            return 100 * shared >= percent * (size[x] + size[others] - shared)

        return hits

    return kernel


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (distinct). Ids are broadcast up to BROADCAST_IDS, else shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    coordinates: int = 32,
    min_matches: int = 14,
    list_limit: int = 8192,
    block_limit: int = 2048,
    block_bytes: int = 8 << 20,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group_key [, carried columns]: a row for each row of ``docs`` (doc_id, text).

    Words are maximal runs of bytes other than ASCII white space, A-Z taken as a-z; a document's set holds
    its distinct shingles of ``shingle`` words, or its whole sequence if it has fewer. Null, empty and
    wordless texts have an empty set and are linked with nothing. Two documents are linked if
    ``100 * |A & B| >= percent * |A | B|``; component_id is the smallest doc_id reachable and kept says
    whether that is the row's own. Rows that repeat a doc_id are documents of their own. A null doc_id is
    nobody's representative and its row has kept = false. group_key is equal for the rows of a component and
    only for them; it is null for empty sets. Columns of docs that ``carry`` names are handed through, all others
    are ignored.
    """
    lean_batches(docs.sparkSession)
    carry = list(carry)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[2:])
    signed = texts.mapInArrow(_signatures(shingle, coordinates, carry), f"doc_id long, n_shingles long, node long, sig binary{kinds}")
    signed = materialise(signed, "signatures")
    worded = signed.where("n_shingles > 0")
    # equal sets have equal sizes and signatures
    classes = worded.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"))
    classes = materialise(classes, "classes")
    reps = classes.where("first is not null").select(F.col("node").alias("id"), "first", "n", "sig")

    # the rarest shared pairs of each class
    total = coordinates * reps.count()
    tokens = reps.select("id", "sig").mapInArrow(_tokens, "id long, token long")
    shared = materialise(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    ranked = (
        join_counted(tokens, shared, "token", "df", total)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # at most ``coordinates`` in each
        .where(F.size("t") >= min_matches)
        .select("id", F.explode(F.slice("t", F.lit(1), F.size("t") - min_matches + 1)).alias("x"))
        .select("id", F.col("x.token").alias("group"))
    )
    ranked = materialise(ranked, "prefixes")
    long = materialise(ranked.groupBy("group").agg(F.count("*").alias("m")).where("m > 1"), "lengths")
    posted = join_counted(ranked, long, "group", "m", total).join(reps.select("id", "n", "sig"), "id")
    lists = materialise(posted.withColumn("blocks", F.ceil(F.col("m") / list_limit).cast("int")), "lists")
    near = linked_groups(lists, _candidates(min_matches, percent))
    near = materialise(near.withColumnsRenamed({"node": "id", "component": "group"}), "near")
    release(ranked, long, lists, shared)

    sized = near.join(reps.select("id", "first", "n"), "id")
    sets = semi_join(texts.select("doc_id", "text"), sized.select(F.col("first").alias("doc_id")).distinct(), "doc_id")
    sets = sets.mapInArrow(_sets(shingle), "id long, set binary").dropDuplicates(["id"])
    sizes = near.join(reps.select("id", "n"), "id").groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("held"))
    blocks = F.greatest(F.ceil(F.col("m") / block_limit), F.ceil(8 * F.col("held") / block_bytes)).cast("int")
    sizes = materialise(sizes.select("group", "m", blocks.alias("blocks")), "sizes")
    members = materialise(join_counted(near, sizes, "group", "m", near.count()).join(sets, "id"), "members")
    linked = materialise(linked_groups(members, _links(percent)), "linked")
    release(near, sizes, members)

    inside = linked.join(classes.select("node", "first"), "node")
    names = materialise(inside.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("k")), "names")
    named = join_counted(linked, names, "component", "k", linked.count()).select("node", "component", "component_id")
    named = classes.select("node", "copies", "first").join(named, "node", "left").select(
        "node", "copies", F.coalesce("component", "node").alias("group_key"), F.coalesce("component_id", "first").alias("component_id")
    )
    named = materialise(named, "named")
    release(linked, names, classes)
    out = join_counted(worded, named, "node", "copies", signed.count()).select("doc_id", "n_shingles", "component_id", "group_key", *carry)
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_key"), *carry)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "group_key", *carry)

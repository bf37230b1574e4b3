import math
import random
import re

import numpy as np
import pytest

from weftgraph.llm import groups, minhash, nndescent


def brute_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not texts:
            texts.append(" ".join(rng.choices(vocab, k=rng.randint(1, 80))))
        else:
            words = (rng.choice(texts[:5]) if kind < 0.7 else rng.choice(texts)).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words) if rng.random() < 0.8 else " ".join(words).upper())
    return texts


def test_minhash_components_equal_brute_force(spark):
    texts = [*corpus(1, 260), None, "", " \n", "one", "One", "two words", "TWO  words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "2 as component", "3 as n", "4 as token", "5 as sig")
    for k, limits in ((2, {}), (5, {"list_limit": 7, "block_limit": 5})):
        out = {r["doc_id"]: r for r in minhash.near_duplicates(df, shingle=k, **limits).collect()}
        sets = [shingle_set(t, k) for t in texts]
        links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        want = brute_components(len(texts), links)
        assert [out[i]["component_id"] for i in range(len(texts))] == want
        assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        assert all(out[i]["kept"] == (want[i] == i) for i in out)


def test_minhash_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (9, "a b c d e f g"), (None, "a b c d e f g"), (7, "other words are in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, shingle=2).collect())
    assert got == [(-1, 5, False), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_intersections_and_spanning_forests():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(12)]
    got = minhash.intersections(sets, cells=96)
    assert (got == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]).all()
    links = np.triu(rng.random((16, 16)) < 0.1, 1)
    links |= links.T
    for label in (None, np.array([0, 0, *range(2, 16)])):
        root, node = groups.trees(16, lambda x, others: links[x, others], label)
        pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(links), strict=True)] + ([(0, 1)] if label is not None else [])
        forest = list(zip(root.tolist(), node.tolist(), strict=True))
        assert brute_components(16, pairs) == brute_components(16, forest) and len(forest) < 16


def test_linked_groups_of_every_shape_and_few_copies(spark, monkeypatch):
    """Dense, sparse and chained groups in blocks of 8: components equal brute force; a dense group's rows are copied few times."""
    rng = random.Random(4)
    place = {}  # id -> (group, position); linked within 1 in a group
    for group, places in ((1, [0.5 * rng.random() for _ in range(300)]), (2, [3.0 * i for i in range(60)]), (3, [0.9 * i for i in range(50)]), (4, [1.0, 1.5])):
        for x in places:
            place[len(place)] = (group, x)
    sizes = {g: sum(1 for h, _ in place.values() if h == g) for g in range(1, 5)}
    rows = [(g, i, sizes[g], -(-sizes[g] // 8), x) for i, (g, x) in place.items()]
    df = spark.createDataFrame(rows, "group long, id long, m long, blocks int, x double")
    dealt, write = [], groups.materialise

    def watch(frame, name, *by):
        out = write(frame, name, *by)
        if name == "met":
            dealt.append(frame.sparkSession.sparkContext._jvm and out.count())
        return out

    monkeypatch.setattr(groups, "materialise", watch)

    def kernel(table):
        x = table["x"].to_numpy()
        return lambda i, others: np.abs(x[others] - x[i]) <= 1

    got = {r["node"]: r["component"] for r in groups.linked_groups(df, kernel).collect()}
    links = [(i, j) for i in place for j in range(i) if place[i][0] == place[j][0] and abs(place[i][1] - place[j][1]) <= 1]
    want = brute_components(len(place), links)
    assert [got.get(i, i) for i in range(len(place))] == want
    dense = df.where("group = 1")
    dealt.clear()
    groups.linked_groups(dense, kernel).collect()
    assert len(dealt) == 1 and dealt[0] < 3 * 300  # one round, each row once and a hub in each block


def test_join_counted_is_an_inner_join(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 3000 + [2] * 5 + [3] * 4)], "k long, i long")
    counted = spark.createDataFrame([(1, 3000, "a"), (2, 5, "b"), (9, 1, "c")], "k long, n long, what string")
    got = groups.join_counted(rows, counted, "k", "n", 3009).groupBy("what").count().collect()
    assert {(r["what"], r["count"]) for r in got} == {("a", 3000), ("b", 5)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nn_descent_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = np.concatenate([base[:40] + rng.normal(scale=0.08, size=(40, 16)), base[0] + rng.normal(scale=0.08, size=(60, 16)), base[5:8]])
    x = np.concatenate([base, near]).tolist()
    rows = list(enumerate(x)) + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1e300] * 16), (905, [2e300] * 16), (906, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as component", "3 as unit", "4 as u", "5 as v")
    out = {r["vec_id"]: r for r in nndescent.near_duplicates(df, cell_rows=64, block_rows=16).collect()}
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = brute_components(len(x), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)])
    got_links = sum(out[i]["n_links"] for i in range(len(x)))
    assert got_links >= 0.99 * linked.sum() and got_links <= linked.sum()
    assert np.mean([out[i]["component_id"] == want[i] for i in range(len(x))]) > 0.99
    assert all((out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True) for i in (900, 901, 902, 903, 906))
    assert out[904]["n_links"] == 1 and out[905]["component_id"] == 904
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


def test_nn_descent_joins_groups_beyond_full_lists(spark):
    """Every vector has more and closer neighbours in its own group than its list holds; the links between the groups are links all the same."""
    rng = np.random.default_rng(12)
    a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    centres = [a, 0.95 * a + np.sqrt(1 - 0.95**2) * b, -a]
    x = np.concatenate([c + rng.normal(scale=0.1 / 8, size=(15, 64)) for c in centres])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    assert linked[:30, :30].all() and linked[30:, 30:].all() and not linked[:30, 30:].any()
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    # without audit queries, which compare all of so few vectors
    out = {r["vec_id"]: r for r in nndescent.near_duplicates(df, audit_queries=0).collect()}
    assert [out[i]["n_links"] for i in range(45)] == [29] * 30 + [14] * 15
    assert [out[i]["component_id"] for i in range(45)] == [0] * 30 + [30] * 15


def test_near_cosines_are_the_same_in_every_block():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    threshold = float(math.fsum(x[3] * x[5]))  # a pair that lies on it
    whole = nndescent.linked(x, x, threshold)
    assert whole[3, 5] and whole[5, 3]
    for step in (1, 3, 7):
        parts = np.concatenate([nndescent.linked(x[i : i + step], x, threshold) for i in range(0, 40, step)])
        assert (parts == whole).all()


def test_nn_descent_of_large_components_and_hot_vectors(spark):
    """Components of many blocks: a hub of saturated lists, a chain of short ones, and one vector in most rows."""
    rng = np.random.default_rng(8)
    hub = rng.normal(size=12) + rng.normal(scale=0.06, size=(120, 12))
    turn = np.arange(90) * 0.3
    chain = np.zeros((90, 12))
    chain[:, 0], chain[:, 1], chain[:, 2] = np.cos(turn), np.sin(turn), turn / 4
    x = np.concatenate([hub, chain, np.tile(rng.normal(size=12), (1500, 1))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = brute_components(len(x), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in nndescent.near_duplicates(df, block_rows=16, audit_queries=0).collect()}
    assert [out[i]["component_id"] for i in range(len(x))] == want
    assert [out[i]["n_links"] for i in range(len(x))] == linked.sum(1).tolist()


def test_a_graph_that_misses_links_is_an_error(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 8)), 2, 0) + rng.normal(scale=1e-3, size=(120, 8))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    assert nndescent.near_duplicates(df).first()["audit_recall"] == 1.0
    monkeypatch.setattr(nndescent, "_nearest", lambda k: lambda batches: iter([]))
    with pytest.raises(ValueError, match="audited links"):
        nndescent.near_duplicates(df, max_restarts=1)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    en, bad = [f"en{chr(97 + i % 26)}word{i}" for i in range(120)], ["idiot", "scum", "moron", "trash", "clown"]
    item = " ".join(rng.choices(en, k=30))
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(en, k=50)
        if i % 10 == 3:
            words[::7] = rng.choices(bad, k=8)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 10 == 3)))
    rows += [(500, rows[0][1], "en", "s", 0), (501, "x " + item + " y z", "en", "s", 0), (502, None, None, None, None), (503, "123", "en", "s", 0)]
    for name, data, kind in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {i for i in range(300) if i % 10 != 3}


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Rows of one doc_id and different texts, repeated rows, null ids and texts, columns of clashing names, an empty table."""
    import corpus_pipeline

    rng = random.Random(12)
    vocab = [f"en{chr(97 + i % 26)}word{i}" for i in range(120)]
    clean = [" ".join(rng.choices(vocab, k=40)) for _ in range(60)]
    bad = "idiot " + " ".join(rng.choices(["idiot", "scum", "moron", "trash"], k=30))
    item = " ".join(rng.choices(vocab, k=30))
    rows = [(i, t, "en") for i, t in enumerate(clean)] + [(100 + i, bad + f" {i} " + clean[i], "en") for i in range(30)]
    odd = [(1, bad + " " + clean[50], "en"), (2, clean[51] + " more", "en"), (3, clean[3], "en"), (4, "so " + item, "en"), (None, clean[20], None), (200, None, None), (201, "", "en")]
    kind = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows + odd, kind).selectExpr("*", "'x' as row", "1L as key", "2L as group_key", "'y' as `a.b`", "3 as toxic", "4 as grade", "5 as score")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, clean[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    by = lambda frame: sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)
    pairs = lambda which: sorted(((i, t) for i, t, _ in which), key=repr)
    first, second, third, fourth, last = (f for _, f in corpus_pipeline.STAGES)
    where = str(tmp_path)
    out = first(spark, docs, where)
    assert out.columns == docs.columns and by(out) == pairs([r for r in rows + odd if r[1]])
    out = second(spark, docs, where)
    assert out.columns == docs.columns and by(out) == pairs([r for r in rows + odd if "idiot" not in (r[1] or "")])
    out = third(spark, docs, where)  # doc 2's other text goes with document 51; the repeated row 3 once
    assert out.columns == docs.columns and by(out) == pairs([r for r in rows + odd if r[:2] not in ((3, clean[3]), (51, clean[51]))] + [(3, clean[3], "en")])
    out = fourth(spark, docs, where)
    assert out.columns == docs.columns and by(out) == pairs([r for r in rows + odd if item not in (r[1] or "")])
    assert last(spark, docs, where).groupBy("doc_id").count().count() == len({i for i, *_ in rows + odd})
    for stage in (first, second, third, fourth, last):
        assert stage(spark, docs.limit(0), where).count() == 0


def test_nn_descent_counts_links_alike_in_small_and_large_components(spark):
    angles = np.arange(120) * 0.2  # each links with the two before and the two after, cos(0.4) = 0.92
    x = np.stack([np.cos(angles / 4), np.sin(angles / 4)], 1)[:100]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = nndescent.linked(x, x, 0.995).sum(1) - 1
    for block_rows in (8, 4096):  # poor lists, so that a count from them would miss links
        found = nndescent.near_duplicates(df, 0.995, neighbours=40, tables=1, cell_rows=8, max_rounds=0, block_rows=block_rows, least_recall=0.0)
        assert [r["n_links"] for r in found.orderBy("vec_id").collect()] == want.tolist()


def test_minhash_lists_of_many_clusters_in_blocks(spark):
    """Clusters of near copies, half of whose shingles all documents have: lists longer than a block that don't hang together."""
    rng = random.Random(11)
    common, texts = [f"c{i}" for i in range(60)], []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(60)]
        for _ in range(3):
            own[rng.randrange(60)] = f"z{rng.random()}"
            texts.append(" ".join(common + own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t, 2) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for limits in ({}, {"list_limit": 16}):
        out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, shingle=2, **limits).collect()}
        assert [out[i] for i in range(len(texts))] == brute_components(len(texts), links)

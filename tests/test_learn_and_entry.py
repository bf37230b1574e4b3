import bz2
import gzip
import lzma
import math
import os
import random

import duckdb
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftgraph import cli
from weftgraph.operators import compress, ensembles, learn, patterns
from weftgraph.operators.ensembles import Neighbours
from weftgraph.plans import catalog
from weftgraph.sources import sinks

SF = "/root/testdata/sf0.001"
CHEAP = ("corpus_expand_runs", "fold_results", "edge_breakdown", "train_predict_chain", "accuracy_by_fold", "r2_by_fold", "impute_mean_mode",
         "ordinal_encode_unknown", "checksum_hash", "sample_exact_n", "task_lists", "expected_runs", "json_attr_extract", "corpus_raw_bytes")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")
@pytest.mark.parametrize("name", CHEAP)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[cols].astype(str).values))
    assert key(got) == key(want)


def test_fold_statistics_ignore_the_test_fold(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (0, None, "b"), (1, 3.0, "b"), (1, 5.0, None), (2, None, "c")], "fold int, x double, s string")
    assert {r["fold"]: r["mean"] for r in learn.train_means(df, "x").collect()} == {0: 4.0, 1: 1.0, 2: 3.0}
    assert {r["fold"]: r["mode"] for r in learn.train_modes(df, "s").collect()} == {0: "b", 1: "a", 2: "b"}
    coded = learn.ordinal_encode(df, "s", learn.train_codes(df, "s"))
    assert {(r["fold"], r["s"]): r["s_code"] for r in coded.collect()}[2, "c"] == -1


def test_r2_of_a_constant(spark):
    df = spark.createDataFrame([(0, 2.0, 2.0), (0, 2.0, 2.0), (1, 2.0, 3.0), (1, 2.0, 2.0)], "k int, y double, p double")
    assert {r["k"]: r["r2"] for r in learn.r2(df, "y", "p", "k").collect()} == {0: 1.0, 1: 0.0}


def test_cross_validation(spark):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("b"), (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    out = learn.execute(df, "y", "classification", "DecisionTree", {"max_depth": 3, "random_state": 42}, folds=3)
    assert [r["score"] for r in out["fold_results"]] == [1.0, 1.0, 1.0] and out["dataset_meta"]["n_classes"] == 2
    assert out["fold_results"][0]["train_size"] == 40
    with pytest.raises(ValueError, match="Unknown model"):
        learn.estimator("Nothing", {}, 1, 2)
    with pytest.raises(NotImplementedError):
        learn.estimator("SVR", {}, 1, 2)


def test_codecs_of_empty_input(spark):
    rows = {r["codec"]: r for r in compress.single_stream(spark.createDataFrame([], "path string, content binary")).collect()}
    assert all(r["raw_bytes"] == 0 and r["space_saving_pct"] == 0 for r in rows.values())


def test_command_line():
    assert cli.real_run_estimate("scaled")[0] == 10368
    args = cli.parser().parse_args(["generate", "-m", "light", "-q", "--no-cardinality-check"])
    assert args.mode == "light" and args.no_cardinality_check


def test_real_execution_runs_the_clients_tasks(spark, tmp_path):
    import json

    import pandas as pd

    from weftgraph import CorpusConfig, CorpusGenerator

    class Task:
        target_name, dataset_id = "y", 77

        def __init__(self, task_id):
            self.task_type = "Supervised Classification" if task_id == 3 else "Clustering"

        def get_dataset(self):
            self.name = "toy"
            return self

        def get_data(self, target, dataset_format):
            x = pd.DataFrame({"a.b": [float(i % 2) for i in range(40)], "c": ["u", None] * 20})
            return x, pd.Series(["no", "yes"] * 20), None, None

        def get_train_test_split_indices(self, fold, repeat):
            return [i for i in range(40) if i // 8 != fold], [i for i in range(40) if i // 8 == fold]

    class Client:
        def get_suite(self, suite_id):
            return [3, 6]

        def get_task(self, task_id):
            return Task(task_id)

    config = CorpusConfig(mode="light", output_dir=str(tmp_path / "c"), n_folds=2, verbose=False, use_real_execution=True)
    with pytest.raises(ValueError, match="task client"):
        CorpusGenerator(config, spark)
    with pytest.raises(SystemExit, match="task client"):
        cli.main(["generate", "-m", "light", "--real"])
    generator = CorpusGenerator(config, spark, Client())
    rows, datasets = generator.execute([(3, "classification"), (6, "classification")])
    assert [r[1:5] for r in rows] == [(1, 1.0, 32, 8), (2, 1.0, 32, 8)]
    assert datasets[3]["n_samples"] == 40 and datasets[3]["n_classes"] == 2 and 6 not in datasets
    found = generator.generate(max_tasks=2)
    assert found["real_execution"] and found["total_runs"] == 2 and found["real_runs"] == 1
    texts = {p.parts[-3]: p.read_text() for p in (tmp_path / "c").rglob("prov_*.json")}
    assert all("77" in json.dumps(json.loads(t)) for k, t in texts.items() if k == "task_3") and set(texts) == {"task_3", "task_6"}


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["predict", "train"]


def blobs(spark, n=90):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        k = i % 3
        rows.append((3.0 * k + rng.gauss(0, 0.4), rng.gauss(0, 1) - 2 * (k == 1), float(k), 10.0 * k + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "a double, b double, k double, y double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_neighbours_equal_brute_force(spark):
    df = blobs(spark)
    rows = [((r["a"], r["b"]), r["k"], r["y"]) for r in df.collect()]
    for classify, config in ((True, {"n_neighbors": 5}), (True, {"n_neighbors": 4, "metric": "manhattan", "weights": "distance"}), (False, {"n_neighbors": 3}), (False, {"n_neighbors": 3, "weights": "distance"})):
        label = "k" if classify else "y"
        got = [r["prediction"] for r in Neighbours(classify, **config).fit(df.withColumn("label", F.col(label))).transform(df).collect()]
        dist = (lambda p, q: abs(p[0] - q[0]) + abs(p[1] - q[1])) if config.get("metric") else math.dist
        for (p, *_), g in zip(rows, got, strict=True):
            near = sorted(((dist(p, q), i, k, y) for i, (q, k, y) in enumerate(rows)))[: config["n_neighbors"]]
            exact = any(d == 0 for d, *_ in near)
            w = [(1.0 if not config.get("weights") else float(d == 0) if exact else 1 / d) for d, *_ in near]
            if classify:
                want = max((0.0, 1.0, 2.0), key=lambda c: (sum(x for x, n in zip(w, near, strict=True) if n[2] == c), -c))
            else:
                want = sum(x * n[3] for x, n in zip(w, near, strict=True)) / sum(w)
            assert g == pytest.approx(want)
    with pytest.raises(ValueError, match="too many"):
        ensembles.NEIGHBOUR_CELLS, old = 10, ensembles.NEIGHBOUR_CELLS
        try:
            Neighbours(True).fit(df.withColumn("label", F.col("k")))
        finally:
            ensembles.NEIGHBOUR_CELLS = old


def test_boosting_learns_what_one_stump_cannot(spark):
    df = blobs(spark)
    found = ensembles.AdaBoost(True, 3, n_estimators=4).fit(df.withColumn("label", F.col("k")))
    assert 2 <= len(found.members) <= 4 and found.transform(df).where("prediction = k").count() >= 85
    found = ensembles.AdaBoost(False, n_estimators=3).fit(df.withColumn("label", F.col("y")))
    assert found.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1


def test_every_model_of_the_grids_has_an_estimator(spark):
    for task_type, grids in (("classification", catalog.classification_grid()), ("regression", catalog.regression_grid())):
        for model, configs in grids.items():
            for config in configs:
                try:
                    assert learn.estimator(model, config, 4, 3) is not None
                except NotImplementedError:
                    assert model in ("SVM", "SVR", "MLPRegressor")
    with pytest.raises(ValueError, match="Unknown model"):
        learn.estimator("Oracle", {}, 1, 2)


def test_streams_equal_one_shot_codecs(spark):
    rows = [(i, f"document {i} " * (i % 7)) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw = b"".join((t or "").encode() for _, t in rows)
    got = {r["codec"]: r for r in compress.single_stream(df, "text", "doc_id").collect()}
    want = {"gzip": len(gzip.compress(raw, 9)), "bz2": len(bz2.compress(raw, 9)), "lzma": len(lzma.compress(raw))}
    assert all(abs(got[k]["compressed_bytes"] - n) <= 64 for k, n in want.items()) and {r["raw_bytes"] for r in got.values()} == {len(raw)}
    each = compress.per_document(df, "doc_id", "text").collect()
    assert len(each) % 201 == 0


def test_malformed_lists_and_patterns(spark, tmp_path):
    (tmp_path / "tasks.txt").write_text("3 6\n11\n")
    assert catalog.read_task_list(tmp_path / "tasks.txt") == [3, 6, 11]
    graph = spark.createDataFrame([("a", "p", "b", True)], "s string, p string, o string, o_is_iri boolean")
    with pytest.raises(ValueError, match="shares no variable"):
        patterns.match(graph, ("?x", "p", "?y"), ("?u", "p", "?v"))


def test_files_are_the_same_when_written_twice(spark, tmp_path):
    docs = spark.createDataFrame([(f"r{i}", i % 2, "M", '{"a": 1}') for i in range(6)], "doc_id string, task_id int, model string, json string")
    first = sorted(r["path"] for r in sinks.write_files(docs, str(tmp_path)).collect())
    assert first == sorted(r["path"] for r in sinks.write_files(docs, str(tmp_path)).collect())
    assert sorted(str(p) for p in tmp_path.rglob("*") if p.is_file()) == first and len(first) == 6
    sinks.write_parquet(docs, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6
    assert sinks.pretty_json(docs).first()["json"] == '{\n  "a": 1\n}'


def test_lzma_of_short_documents_has_the_size_of_preset_9_at_little_cost():
    import lzma
    import random
    import time

    rng = random.Random(5)
    words = ["a", "lorem", "ipsum", "<div class='x'>", "\n", "0123"]
    texts = [b"", b"x", b"ab" * 4000, bytes(rng.randbytes(5000)), "".join(rng.choices(words, k=20000)).encode(), b"".join(bytes([i % 7]) * i for i in range(300))]
    for t in texts:
        packed = compress._lzma(t)
        assert len(packed) == len(lzma.compress(t, preset=9)) and lzma.decompress(packed) == t
    begin = time.process_time()
    for _ in range(100):
        compress._lzma(b"short")
    assert time.process_time() - begin < 1  # 4 s with the preset's dictionary


def test_codecs_work_side_by_side_on_one_sorted_pass(spark, monkeypatch):
    import random
    import threading

    rng = random.Random(3)
    rows = [(i % 3, "".join(rng.choices("abcdefgh \n", k=rng.randrange(4000)))) for i in range(400)]
    raw = "".join(t for _, t in sorted(rows)).encode()
    df = spark.createDataFrame(sorted(rows, reverse=True), "doc_id long, text string")  # equal ids: by the content
    found = compress.single_stream(df, "text", "doc_id")
    got = {r["codec"]: r["compressed_bytes"] for r in found.collect()}
    assert got == {"gzip": len(gzip.compress(raw, 9)), "bz2": len(bz2.compress(raw, 9)), "lzma": len(lzma.compress(raw, preset=9))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1 and "Union" not in plan

    met = threading.Barrier(len(compress.CODECS))

    class Meeting:
        def compress(self, data):
            met.wait(10)  # breaks unless all codecs are at work
            return data

        flush = bytes

    monkeypatch.setattr(compress, "_compressor", lambda codec: (Meeting(), 0))
    size = 2 * compress._PIECE + 5
    assert [(r["codec"], r["n_files"], r["raw_bytes"], r["compressed_bytes"]) for r in compress._pack([[b"x" * size, b""], [b"y"]])] == [(c, 3, size + 1, size + 1) for c in compress.CODECS]

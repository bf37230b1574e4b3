import json

import pytest
from pyspark.sql import functions as F

from weftgraph import queries
from weftgraph.api import CorpusConfig, CorpusGenerator, ProvDocumentBuilder, evaluate
from weftgraph.model import RELATIONS, expected_counts
from weftgraph.operators import documents, generate, patterns, stats, validate
from weftgraph.sources import corpus
from weftgraph.streaming import ingest

ENV = {f"ml:{k}": "x" for k in "abcde"}


def runs(spark, kind="classification", n=2):
    rows = [(t, kind, t, 1000 + t, 10, "RandomForest", 0, "{}", 0.85, "accuracy" if kind == "classification" else "r2_score") for t in range(n)]
    names = "task_id long, task_type string, dataset_id long, n_samples long, n_features long, model string, cfg_idx int, params_json string, base_score double, metric string"
    df = spark.createDataFrame(rows, names).withColumn("now", F.lit("2024-01-01").cast("timestamp"))
    return df.withColumn("run_id", F.concat(F.lit("run"), F.col("task_id").cast("string")))


@pytest.mark.parametrize("folds", [1, 3, 5])
def test_counts_follow_the_folds(spark, folds):
    nodes, edges = generate.generate(runs(spark, n=1), folds, environment=ENV)
    row = stats.document_stats(nodes, edges).first().asDict()
    want = expected_counts(folds)
    assert {k: row[k] for k in want} == want
    assert row["used"] == 5 + 11 * folds and row["wasGeneratedBy"] == 3 * folds + 1 and row["wasAttributedTo"] == folds
    assert nodes.agg(F.sum(F.size("attrs"))).first()[0] == 38 + 29 * folds
    assert edges.groupBy("rel").agg((F.countDistinct("edge_id") == F.count("*")).alias("ok")).where("not ok").count() == 0


def test_documents_round_trip_and_validate(spark):
    nodes, edges = generate.generate(runs(spark), 5, environment=ENV)
    docs = documents.to_documents(nodes, edges)
    out = validate.validate(docs).collect()
    assert all(r["valid"] and r["summary"] == "ok" for r in out) and len(out) == 2
    assert validate.round_trip_diff(nodes, edges).where("only_first + only_second > 0").count() == 0
    doc = json.loads(docs.first()["json"])
    assert sum(len(doc[r]) for r in RELATIONS) == 128
    assert isinstance(next(iter(doc["entity"].values()))["prov:type"], str)
    metrics = [v for k, v in doc["entity"].items() if k.startswith("e:metrics/")]
    assert all(isinstance(m["openml:accuracy"], float) for m in metrics)


def test_shared_experiment_counts_once_and_labels_multiply(spark):
    one = runs(spark, n=1)
    two = one.unionByName(one.withColumn("run_id", F.lit("again")).withColumn("model", F.lit("KNN")))
    three = two.unionByName(one.withColumn("run_id", F.lit("third")))
    nodes, edges = generate.generate(three, 5, environment=ENV)
    assert patterns.count_runs(nodes, edges).first()[0] == 2
    labels = patterns.triples(nodes, edges).where("s = 'ag:system/OpenML' and p = 'prov:label'")
    assert labels.count() == 2


def test_regression_runs_have_no_accuracies(spark):
    nodes, edges = generate.generate(runs(spark, "regression"), 5, environment=ENV)
    assert patterns.per_fold_accuracies(nodes, edges).count() == 0


def small():
    b = ProvDocumentBuilder()
    b.add_agent("ag:x", {"prov:type": "T"})
    b.add_entity("e:x", {"prov:type": "T"})
    b.add_activity("a:x", {"prov:type": "T"})
    b.add_used("a:x", "e:x", "data")
    b.add_association("a:x", "ag:x")
    return b.doc


MUTANTS = [
    (lambda d: d.pop("prefix"), "missing or malformed 'prefix' block"),
    (lambda d: d["prefix"].pop("ag"), "missing required prefix 'ag'"),
    (lambda d: d.update(entity=[1]), "missing or malformed 'entity' block"),
    (lambda d: d["agent"].update({"ag:y": 3}), "agent 'ag:y' attributes not an object"),
    (lambda d: d["entity"].update({"e:y": {}}), "entity 'e:y' missing prov:type"),
    (lambda d: d.update(wasDerivedFrom=[]), "relation block 'wasDerivedFrom' not an object"),
    (lambda d: d["used"].update({"_:u1": 1}), "used '_:u1' not an object"),
    (lambda d: d["used"]["_:u1"].pop("prov:entity"), "used '_:u1' missing prov:entity"),
    (lambda d: d["used"]["_:u1"].update({"prov:entity": "e:no"}), "used '_:u1' prov:entity='e:no' not a declared entity"),
    (lambda d: d["used"]["_:u1"].update({"prov:entity": None}), "used '_:u1' prov:entity=None not a declared entity"),
    (lambda d: d["used"]["_:u1"].update({"prov:entity": ["x"]}), "used '_:u1' prov:entity=[\"x\"] not a declared entity"),
]


def outcomes(spark, docs, checks=validate.CHECKS, cardinality=False):
    """Errors by check of documents, by their position."""
    df = spark.createDataFrame([(f"{i:04}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "doc_id string, json string")
    rows = validate.validate(df, checks, cardinality).orderBy("doc_id").collect()
    return [{c["name"]: c["errors"] for c in r["checks"]} for r in rows]


def test_each_rule_names_its_defect(spark):
    docs = [small() for _ in range(len(MUTANTS) + 1)]
    for doc, (mutate, _) in zip(docs, MUTANTS, strict=False):
        mutate(doc)
    *found, clean = outcomes(spark, docs, ("schema",))
    assert clean == {"schema": []}
    for errors, (_, message) in zip(found, MUTANTS, strict=True):
        assert message in errors["schema"]


def test_missing_relation_block_null_type_and_cardinality(spark):
    doc = small()
    del doc["wasInformedBy"]
    doc["entity"]["e:x"]["prov:type"] = None
    assert outcomes(spark, [doc], ("schema",)) == [{"schema": []}]
    full, *others = outcomes(spark, [doc, [1], "no json", '{"a": 1, "a": 2}', "3", "null"], ("schema",), True)
    assert "nodes=3, expected 44" in full["schema"] and len(full["schema"]) == 4
    assert all(x["schema"] == ["document is not a JSON object"] for x in others)


def test_shape_of_activities(spark):
    doc = small()
    doc["activity"]["a:y"] = {"prov:type": "T"}
    doc["wasAssociatedWith"]["_:a2"] = {"prov:activity": "a:x", "prov:agent": "e:x"}
    many = small()
    many["activity"].update({f"a:{i:02}": {"prov:type": "T"} for i in range(14)})
    clean, wrong, cut = outcomes(spark, [small(), doc, many], ("shacl", "round_trip"))
    assert clean == {"shacl": [], "round_trip": []}
    assert wrong["shacl"] == ["Activity has no prov:wasAssociatedWith agent: a:y", "Value of prov:wasAssociatedWith is not a prov:Agent: a:x -> e:x"]
    assert len(cut["shacl"]) == 10 and cut["round_trip"] == []


def test_number_literals_keep_their_form(spark):
    texts = ["1.0", "0.0", "-2.0", "1e-05", "1", "0", "123456789012345678", "12345678901234567890123", "2.50", "0.123456", "1E5", "true", "null", '"1.0"', "[1.5]"]
    doc = small()
    doc["entity"]["e:x"] |= {f"x{i}": "@@" + t + "@@" for i, t in enumerate(texts)}
    text = json.dumps(doc).replace("\\", "")
    for t in texts:
        text = text.replace('"@@' + t + '@@"', t)
    nodes, edges = documents.to_tables(spark.createDataFrame([("d", text)], "doc_id string, json string"))
    got = nodes.where("node_id = 'e:x'").first()["attrs"]
    want = ["1.0", "0.0", "-2.0", "1.0E-5", "1", "0", "123456789012345678", "12345678901234567890123", "2.5", "0.123456", "100000.0", "true", "null", '"1.0"', "[1.5]"]
    assert [got[f"x{i}"] for i in range(len(texts))] == want
    assert [json.loads(a) == json.loads(b) for a, b in zip(texts, want, strict=True)] == [True] * len(texts)
    assert validate.round_trip_diff(nodes, edges).collect()[0][1:] == (0, 0)
    assert outcomes(spark, [text]) == [{"schema": [], "shacl": [], "round_trip": []}]


def test_round_trip_counts_lost_statements(spark):
    nodes, edges = documents.to_tables(spark.createDataFrame([("d", json.dumps(small())), ("f", json.dumps(small()))], "doc_id string, json string"))
    twice = nodes.unionAll(nodes.where("doc_id = 'd' and kind = 'agent'"))  # a document can't say it twice
    got = {r["doc_id"]: (r["only_first"], r["only_second"]) for r in validate.round_trip_diff(twice, edges).collect()}
    assert got == {"d": (1, 0), "f": (0, 0)}
    assert validate.round_trip_errors(twice, edges).first()["message"] == "RDF graphs not isomorphic: +1/-0 triples"


def test_policies_and_report(spark):
    bad = small()
    bad["entity"]["e:y"] = {}
    rows = [(f"d{i:03}", json.dumps(bad)) for i in range(201)] + [("ok", json.dumps(small())), ("null", None), ("text", "no json")]
    docs = spark.createDataFrame(rows, "doc_id string, json string")
    out = validate.validate(docs, ("schema",), cardinality=False).persist()
    report = validate.report(out, "strict", ("schema",))
    assert (report["documents_validated"], report["documents_passed"], len(report["failures"])) == (204, 1, 200)
    assert validate.gate(docs, out, "strict").count() == 1
    assert validate.gate(docs, out, "warn").count() == 204
    with pytest.raises(RuntimeError, match="aborting"):
        validate.gate(docs, out, "abort")
    with pytest.raises(ValueError, match="Unknown check"):
        validate.check_names(["shape"])
    assert validate.validate(docs.limit(0)).count() == 0


def test_table_rules_agree_with_document_rules(spark):
    nodes, edges = generate.generate(runs(spark), 5, environment=ENV)
    nodes = nodes.withColumn("ptype", F.when(F.col("node_id") != "e:env/run1", F.col("ptype")))
    edges = edges.withColumn("dst", F.when((F.col("edge_id") == "_:g1") & (F.col("doc_id") == "run1"), "a:no").otherwise(F.col("dst")))
    got = [r["message"] for r in validate.table_errors(nodes, edges).orderBy("stage", "item").collect()]
    assert got == ["entity 'e:env/run1' missing prov:type", "wasGeneratedBy '_:g1' prov:activity='a:no' not a declared activity"]


def test_generate_and_evaluate_a_corpus(spark, tmp_path):
    config = CorpusConfig(mode="light", output_dir=str(tmp_path / "corpus"), validate=True, verbose=False)
    found = CorpusGenerator(config, spark).generate(max_tasks=2)
    assert found["total_runs"] == 2 and found["graph_structure"]["edges_per_graph"]["max"] == 128
    manifest = json.loads((tmp_path / "corpus" / "corpus_manifest.json").read_text())
    assert manifest["stats"]["total_bytes"] == sum(p.stat().st_size for p in (tmp_path / "corpus").rglob("prov_*.json"))
    report = json.loads((tmp_path / "corpus" / "conformance_report.json").read_text())
    assert report["documents_passed"] == 2
    results = evaluate(spark, str(tmp_path / "corpus"), "light", None, str(tmp_path / "out"), verbose=False)
    rows = {q["id"]: (q["result_rows"], q["result_value"]) for q in results["queries"]["queries"]}
    assert rows == {"count_runs": (1, 2), "per_fold_accuracies": (10, None), "train_predict_chain": (10, None), "model_lineage": (10, None), "aggregate_derivation": (10, None)}
    assert results["compression"]["codecs"]["gzip"]["ratio"] > 3 and (tmp_path / "out" / "eval_light_queries.tex").exists()
    with pytest.raises(SystemExit):
        evaluate(spark, str(tmp_path / "out"))


def test_ingest_of_repeated_batches(spark, tmp_path):
    """Files arrive in two steps; a batch that runs again overwrites its own rows."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    bad = small()
    bad["entity"]["e:y"] = {}

    def arrive(name, doc):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"prov_{name}.json").write_text(json.dumps(doc))

    def run(where):
        ingest.ingest(spark, source, out, where, ("schema",), "strict", False).awaitTermination()

    arrive("a", small())
    arrive("b", bad)
    run(state)
    assert spark.read.parquet(f"{out}/outcomes").count() == 2 and spark.read.parquet(f"{out}/nodes").count() == 3
    run(state)  # nothing new
    arrive("c", small())
    run(state)
    assert spark.read.parquet(f"{out}/outcomes").groupBy("valid").count().collect() and spark.read.parquet(f"{out}/nodes").count() == 6
    run(str(tmp_path / "state2"))  # all files again, as batch 0
    assert spark.read.parquet(f"{out}/outcomes").where("batch = 0").count() == 3
    assert spark.read.parquet(f"{out}/edges").where("batch = 0").count() == 4


def test_env_files_never_override(tmp_path, monkeypatch):
    monkeypatch.setenv("WEFT_A", "kept")
    monkeypatch.delenv("WEFT_B", raising=False)
    (tmp_path / ".env").write_text("WEFT_A=new\nexport WEFT_B='x y'\n# no\n\nbroken line\n")
    assert corpus.load_env_file(tmp_path / ".env") == {"WEFT_A": "kept", "WEFT_B": "x y"}
    assert corpus.load_env_file(tmp_path / "none") == {}
    monkeypatch.delenv("WEFT_B")


def test_exact_documents_round_as_python_does(spark):
    found = generate.generate(runs(spark), 5, exact=True, environment=ENV, whole=True)[0].where("ptype = 'openml:Metrics'")
    shown = {r["node_id"]: float(r["v"]) for r in found.select("node_id", F.coalesce(F.col("attrs")["openml:accuracy"], F.col("attrs")["openml:r2_score"]).alias("v")).collect()}
    raw = generate.fold_results(runs(spark), 5, exact=True).select(F.concat(F.lit("e:metrics/"), "run_id", F.lit("_fold"), "fold").alias("id"), "score").collect()
    assert shown == {r["id"]: round(r["score"], 6) for r in raw}


def test_rules_over_rows_are_those_over_tables(spark):
    some = runs(spark, n=6)
    docs = generate.run_documents(some.unionByName(some.where("task_id = 5")), 2, ENV, "json", ("task_id",))
    copies = {r["doc_id"]: (r["copies"], r["n"]) for r in docs.select("doc_id", "copies", (F.size("entity")).alias("n")).collect()}
    assert len(copies) == 6 and copies["run5"] == (2, 28) and copies["run0"] == (1, 14)
    to = lambda n, name, value: F.when(F.col("task_id") == n, value).otherwise(F.col(name))
    dst = lambda value: lambda e: F.struct(e["edge_id"].alias("edge_id"), e["src"].alias("src"), value.alias("dst"), e["role"].alias("role"))
    docs = docs.withColumns({
        "used": to(1, "used", F.transform("used", dst(F.lit("e:it's")))), "wasAttributedTo": to(2, "wasAttributedTo", F.transform("wasAttributedTo", dst(F.lit(None).cast("string")))),
        "agent": to(3, "agent", F.slice("agent", 1, 0)), "wasAssociatedWith": to(4, "wasAssociatedWith", F.slice("wasAssociatedWith", 2, 3)),
    }).drop("task_id")
    found = validate.row_errors(docs, folds=2).select("doc_id", "schema", "shacl").persist()
    nodes, edges = (t.persist() for t in documents.tables_of(docs))
    for name, rows in (("schema", validate.table_errors(nodes, edges, folds=2)), ("shacl", validate.shacl_errors(nodes, edges))):
        want = sorted(map(tuple, rows.select("doc_id", "stage", "item", "message").collect()))
        got = sorted(map(tuple, found.select("doc_id", F.inline(name)).select("doc_id", "stage", "item", "message").collect()))
        assert got == want and {r[0] for r in got} >= {"run3", "run4"}


def test_rules_of_the_graph_queries_shuffle_no_edges(spark):
    for query in (queries.conformance_report, queries.validate_schema_errors):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") <= 2 and "LeftAnti" not in plan  # the broadcast grid, once in each branch


def test_predicates_count_distinct_triples_of_shared_and_own_nodes(spark):
    one = runs(spark, n=3)
    more = one.withColumn("run_id", F.concat(F.lit("again"), "task_id")).withColumn("model", F.lit("KNN"))
    all_runs = one.unionByName(more).unionByName(one.where("task_id = 1"))  # shared datasets, and a run twice
    want = patterns.triples(*documents.tables_of(generate.run_documents(all_runs, 2, ENV, "json"))).groupBy("p").count()
    docs = generate.run_documents(all_runs, 2, ENV, "plain")
    assert sorted(map(tuple, patterns.predicate_counts(docs).collect())) == sorted(map(tuple, want.collect()))


def test_json_of_rows_is_that_of_tables(spark):
    some = runs(spark, n=3)
    docs = generate.run_documents(some.unionByName(some.where("task_id = 2")), 2, ENV, "json")
    odd = F.transform("agent", lambda n: F.struct(F.lit('ag:"\\ü\n').alias("node_id"), n["ptype"].alias("ptype"), n["attrs"].alias("attrs")))
    docs = docs.withColumn("agent", F.when(F.col("doc_id") == "run1", odd).otherwise(F.col("agent"))).persist()
    got = dict(documents.with_json(docs).select("doc_id", "json").collect())
    assert got == dict(documents.to_documents(*documents.tables_of(docs)).select("doc_id", "json").collect()) and len(got) == 3
    assert 'ag:"\\ü\n' in json.loads(got["run1"])["agent"]


def test_round_trip_of_rows_is_that_of_tables(spark):
    some = runs(spark, n=3)
    docs = generate.run_documents(some.unionByName(some.where("task_id = 2")), 2, ENV, "json")
    said = F.transform("agent", lambda n: F.struct(n["node_id"].alias("node_id"), n["ptype"].alias("ptype"), F.create_map(F.lit("x"), F.lit("2.50"), F.lit("a"), F.lit("1e-05")).alias("attrs")))
    docs = docs.withColumn("agent", F.when(F.col("doc_id") == "run1", said).otherwise(F.col("agent"))).persist()
    got = sorted(map(tuple, validate.round_trip_rows(docs).select("doc_id", "only_first", "only_second").collect()))
    assert got == sorted(map(tuple, validate.round_trip_diff(*documents.tables_of(docs)).collect()))
    assert got == [("run0", 0, 0), ("run1", 0, 0), ("run2", 23 + 56, 0)]  # a document can't say a run's parts twice


def test_blocks_that_are_null_or_no_objects(spark):
    null = small()
    null["used"] = None
    null["wasInformedBy"] = 3
    kinds = small() | {"prefix": None, "agent": None, "entity": "x"}
    kinds["used"]["_:u2"] = None
    first, second, none = outcomes(spark, [null, kinds, "[]"], ("schema",))
    assert first["schema"] == ["relation block 'used' not an object", "relation block 'wasInformedBy' not an object"]
    assert second["schema"][:3] == ["missing or malformed 'prefix' block", "missing or malformed 'entity' block", "missing or malformed 'agent' block"]
    assert "used '_:u2' not an object" in second["schema"] and none["schema"] == ["document is not a JSON object"]


def test_validator_joins_nothing(spark):
    docs = spark.createDataFrame([("d", json.dumps(small()))], "doc_id string, json string")
    plan = validate.validate(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_round_trip_query_joins_only_the_grid(spark):
    plan = queries.round_trip_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2 and "Expand" not in plan

"""From tasks and grids to runs, fold results, nodes and edges.

Everything here is a narrow expansion of the runs table: only a run's aggregate scores shuffle. Node
types and relations are branches of a union with literal ptype and rel, so a filter on either folds the
other branches away, and columns that a query doesn't use (attributes above all) aren't computed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.model import KINDS, RELATIONS

AGENT = "ag:system/OpenML"
INT, TEXT = "int", "text"
_STAMPS = {"train_start": 0, "train_end": 3, "pred_start": 4, "pred_end": 5, "eval_start": 6, "eval_end": 7}


def expand_runs(tasks: DataFrame, grid: DataFrame) -> DataFrame:
    """tasks (task_id, task_type, ...) x configurations of the type: one row a run, with run_id. The grid has at
    most a few hundred rows and is broadcast."""
    runs = tasks.join(F.broadcast(grid), "task_type")
    ordinal = [F.col("task_ord")] if "task_ord" in tasks.columns else []
    return runs.withColumn("run_id", S.run_id(F.col("task_id"), F.col("model"), F.col("cfg_idx"), *ordinal))


def with_datasets(runs: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Adds dataset_id, n_samples, n_features, metric: from ``datasets`` (task_id, ...), else synthetic ones by rule."""
    metric = F.when(F.col("task_type") == "classification", "accuracy").otherwise("r2_score")
    if datasets is not None:
        return runs.join(datasets.select("task_id", "dataset_id", "n_samples", "n_features"), "task_id").withColumn("metric", metric)
    h = lambda salt, lo, hi: F.pmod(F.crc32(F.concat_ws("|", F.lit(salt), F.col("task_id").cast("string")).cast("binary")), F.lit(hi - lo + 1)) + lo
    return runs.select("*", F.col("task_id").alias("dataset_id"), h("samples", 500, 50000).alias("n_samples"), h("features", 10, 500).alias("n_features"), metric.alias("metric"))


def synthetic_datasets(spark: SparkSession, tasks: list[tuple[int, str]], real: dict[int, dict] | None = None) -> DataFrame:
    """The datasets that Python's generator gives for a task list (at most some hundred tasks); those in ``real`` replace them."""
    rows = {t: S.dataset_info(t, kind) for t, kind in tasks} | (real or {})
    cols = ("dataset_id", "dataset_name", "n_samples", "n_features", "n_classes", "task_type", "metric")
    return spark.createDataFrame(
        [(t, *(d[c] for c in cols)) for t, d in rows.items()],
        "task_id long, dataset_id long, dataset_name string, n_samples long, n_features long, n_classes long, task_type string, metric string",
    )


def fold_results(runs: DataFrame, folds: int = 5, exact: bool = False, real: DataFrame | None = None) -> DataFrame:
    """One row for each fold of each run: fold (from 1), score, train_size, test_size and offsets or stamps.

    ``real`` (run_id, fold, score, train_size, test_size, six stamps) replaces synthetic values where it has them.
    """
    f0 = F.col("fold") - 1
    base = F.coalesce(F.col("base_score"), F.lit(0.75))
    score = S.exact_score(base, F.col("task_id"), F.col("cfg_idx"), f0) if exact else S.native_score(base, F.col("task_id"), F.col("cfg_idx"), f0)
    out = runs.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    train = S.train_size(F.col("n_samples"))
    added = {"score": score, "train_size": train, "test_size": F.col("n_samples") - train}
    out = out.withColumns(added | {name: S.stamp(F.col("now"), f0 * 10 + shift) for name, shift in _STAMPS.items()})
    if real is None:
        return out
    names = ["score", "train_size", "test_size", *_STAMPS]
    measured = real.select("run_id", "fold", *[F.col(c).alias(f"real_{c}") for c in names])
    out = out.join(measured, ["run_id", "fold"], "left")
    return out.select(*[F.coalesce(f"real_{c}", c).alias(c) if c in names else F.col(c) for c in out.columns if not c.startswith("real_")])


def _attributes(*pairs: tuple[str | Column, Column, str]) -> Column:
    """A map of attribute names to JSON literals; null values are left out."""
    entries = []
    for key, value, kind in pairs:
        k = F.lit(key) if isinstance(key, str) else key
        entries.append(F.struct(k.alias("key"), (S.json_string(value) if kind == TEXT else value.cast("string")).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _plain_attributes(*pairs: tuple[str | Column, Column, str]) -> Column:
    """The same as an array (key, value) of texts that aren't quoted."""
    entries = [F.struct((F.lit(k) if isinstance(k, str) else k).alias("key"), v.cast("string").alias("value")) for k, v, _ in pairs]
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())


def _node(kind: str, node_id: Column, ptype: str, label: Column | None, *pairs) -> list[Column]:
    first = [("prov:label", label, TEXT)] if label is not None else []
    return [
        F.lit(kind).alias("kind"), node_id.alias("node_id"), F.lit(ptype).alias("ptype"),
        _attributes(*first, ("prov:type", F.lit(ptype), TEXT), *pairs).alias("attrs"),
    ]


def _id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _times(start: Column, end: Column) -> list[tuple]:
    return [("prov:startTime", start, TEXT), ("prov:endTime", end, TEXT)]


def _title(task_type: Column) -> Column:
    """initcap, which is slow (19 of 273 samples of document_validation), only for other types than the two."""
    known = F.when(task_type == "classification", "Classification").when(task_type == "regression", "Regression")
    return known.otherwise(F.initcap(task_type))


Get = Callable[[str], Column]


def _one_nodes(c: Get, environment: dict[str, str] | None, node: Callable) -> list:
    """A run's own nodes but for its aggregate scores; c gives the columns of runs."""
    env = [(k, F.lit(v), TEXT) for k, v in sorted((environment or {}).items())]
    return [
        node("agent", F.lit(AGENT), "prov:SoftwareAgent", _id("OpenML sklearn - ", c("model"))),
        node(
            "entity", _id("e:dataset/", c("dataset_id")), "openml:Dataset", _id("Dataset ", c("dataset_id")),
            ("openml:data_id", c("dataset_id"), INT), ("ml:n_samples", c("n_samples"), INT), ("ml:n_features", c("n_features"), INT),
            ("ml:task_type", c("task_type"), TEXT), ("checksum:sha256", S.sha256_of_string(_id("ds_", c("dataset_id"))), TEXT),
        ),
        node(
            "entity", _id("e:task/", c("task_id")), "openml:Task", _id("Task ", c("task_id")),
            ("openml:task_id", c("task_id"), INT), ("openml:task_type", _id("Supervised ", _title(c("task_type"))), TEXT),
        ),
        node(
            "entity", _id("e:flow/", c("run_id")), "openml:Flow", _id("Flow: ", c("model")),
            ("openml:model", c("model"), TEXT), ("openml:flow_hash", F.substr(F.sha2(c("params_json"), 256), F.lit(1), F.lit(16)), TEXT),
        ),
        node(
            "entity", _id("e:flowparams/", c("run_id")), "openml:FlowParameters", _id("", c("model"), " cfg ", c("cfg_idx")),
            ("openml:parameters", c("params_json"), TEXT), ("checksum:sha256", F.sha2(c("params_json"), 256), TEXT),
        ),
        node("entity", _id("e:env/", c("run_id")), "openml:Environment", None, *env),
        node(
            "activity", experiment_id(), "openml:Experiment", _id("Experiment: ", c("model"), " cfg", c("cfg_idx"), " task", c("task_id")),
            *_times(S.stamp(c("now")), S.stamp(c("now"), 60)),
        ),
        node("activity", _id("a:aggregate/", c("run_id")), "openml:AggregateEvaluate", F.lit("Aggregate")),
    ]


def _fold_nodes(c: Get, node: Callable) -> list:
    """A fold's nodes; c gives the columns of fold results."""
    tag = lambda kind: _id(kind, c("run_id"), "_fold", c("fold"))
    label = lambda text: _id(text, c("fold"))
    hashed = lambda text: ("checksum:sha256", S.sha256_of_string(tag(text)), TEXT)
    return [
        node(
            "entity", tag("e:split/"), "openml:Split", label("Split fold "), ("fold:number", c("fold"), INT),
            ("fold:train_size", c("train_size"), INT), ("fold:test_size", c("test_size"), INT),
        ),
        node("activity", tag("a:train/"), "openml:Train", label("Train fold "), *_times(c("train_start"), c("train_end"))),
        node("entity", tag("e:model/"), "openml:Model", label("Model fold "), ("openml:model_name", c("model"), TEXT), hashed("mdl_")),
        node("activity", tag("a:predict/"), "openml:Predict", label("Predict fold "), *_times(c("pred_start"), c("pred_end"))),
        node("entity", tag("e:predictions/"), "openml:Predictions", label("Predictions fold "), ("ml:n_predictions", c("test_size"), INT), hashed("preds_")),
        node("activity", tag("a:evaluate/"), "openml:Evaluate", label("Evaluate fold "), *_times(c("eval_start"), c("eval_end"))),
        node(
            "entity", tag("e:metrics/"), "openml:Metrics", label("Metrics fold "),
            (_id("openml:", c("metric")), c("score6"), INT), ("openml:n_samples", c("test_size"), INT),
        ),
    ]


def _total_node(c: Get, folds: int, node: Callable):
    return node(
        "entity", _id("e:metrics_agg/", c("run_id")), "openml:AggregateMetrics", F.lit("Aggregate Metrics"),
        (_id("openml:", c("metric"), "_mean"), c("score_mean"), INT), (_id("openml:", c("metric"), "_std"), c("score_std"), INT),
        ("openml:n_folds", F.lit(folds), INT),
    )


def run_nodes(runs: DataFrame, results: DataFrame, folds: int = 5, environment: dict[str, str] | None = None, whole: bool = False, exact: bool = False) -> DataFrame:
    """All nodes: 9 and 7 for each fold, of each run. ``results`` are the fold results of ``runs``. whole: for readers of
    all nodes with their attributes, a run's and a fold's nodes are made together, from one scan each. exact: scores
    are rounded as Python does."""
    results = results.withColumn("score6", S.python_round(6)("score") if exact else F.bround("score", 6))
    totals = with_aggregates(runs, results)
    for name in ("score_mean", "score_std"):
        totals = totals.withColumn(name, S.python_round(6)(name) if exact else F.bround(name, 6))
    one, each = _one_nodes(F.col, environment, _node), _fold_nodes(F.col, _node)
    total = _total_node(F.col, folds, _node)
    key = F.col("run_id").alias("doc_id")
    if whole:
        together = lambda nodes: F.inline(F.array(*[F.struct(*cols) for cols in nodes]))
        branches = [runs.select(key, together(one)), results.select(key, together(each))]
    else:
        branches = [runs.select(key, *cols) for cols in one] + [results.select(key, *cols) for cols in each]
    return reduce(DataFrame.unionByName, [*branches, totals.select(key, *total)])


def with_aggregates(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each run's fold scores."""
    found = results.groupBy("run_id").agg(F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))
    return runs.join(found, "run_id", "left")


def experiment_id() -> Column:
    """Without the run's id: runs of the same task, model and configuration share it."""
    return _id("a:experiment/t", F.col("task_id"), "_", F.col("model"), "_cfg", F.col("cfg_idx"))


def _edge_lists(c: Get, folds: int) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """(relation, struct of edge_id, src, dst, role) of a run, and of a fold; c gives the columns of runs and ``fold``."""
    agent = F.lit(AGENT)
    data, task = _id("e:dataset/", c("dataset_id")), _id("e:task/", c("task_id"))
    flow, params, env = (_id(f"e:{x}/", c("run_id")) for x in ("flow", "flowparams", "env"))
    aggregate, total = _id("a:aggregate/", c("run_id")), _id("e:metrics_agg/", c("run_id"))
    fold, f0 = c("fold"), c("fold") - 1
    tag = lambda kind: _id(kind, c("run_id"), "_fold", fold)
    split, train, model, predict, preds, evaluate, metrics = (
        tag(x) for x in ("e:split/", "a:train/", "e:model/", "a:predict/", "e:predictions/", "a:evaluate/", "e:metrics/")
    )

    def edge(rel: str, number: Column, src: Column, dst: Column, role: str | None = None) -> tuple[str, Column]:
        letter = RELATIONS[rel][4]
        body = (_id(f"_:{letter}", number.cast("int")).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(role).cast("string").alias("role"))
        return rel, F.struct(*body)

    used = lambda n, src, pairs: [edge("used", n + i, src, dst, role) for i, (dst, role) in enumerate(pairs)]
    n = F.lit(folds)
    one = [
        edge("wasAssociatedWith", F.lit(1), experiment_id(), agent),
        *used(F.lit(1), experiment_id(), [(data, "dataset"), (task, "task"), (flow, "flow"), (params, "params"), (env, "env")]),
        edge("wasAssociatedWith", 3 * n + 2, aggregate, agent),
        edge("wasGeneratedBy", 3 * n + 1, total, aggregate),
    ]
    each = [
        edge("wasAssociatedWith", 3 * f0 + 2, train, agent),
        *used(10 * f0 + 6, train, [(data, "data"), (split, "split"), (flow, "flow"), (params, "params"), (env, "env")]),
        edge("wasInformedBy", 3 * f0 + 1, train, experiment_id()),
        edge("wasGeneratedBy", 3 * f0 + 1, model, train),
        edge("wasAttributedTo", fold, model, agent),
        edge("wasAssociatedWith", 3 * f0 + 3, predict, agent),
        *used(10 * f0 + 11, predict, [(model, "model"), (data, "data"), (split, "split")]),
        edge("wasInformedBy", 3 * f0 + 2, predict, train),
        edge("wasGeneratedBy", 3 * f0 + 2, preds, predict),
        edge("wasAssociatedWith", 3 * f0 + 4, evaluate, agent),
        *used(10 * f0 + 14, evaluate, [(preds, "predictions"), (split, "split")]),
        edge("wasInformedBy", 3 * f0 + 3, evaluate, predict),
        edge("wasGeneratedBy", 3 * f0 + 3, metrics, evaluate),
        edge("wasDerivedFrom", 2 * f0 + 1, metrics, preds),
        edge("wasDerivedFrom", 2 * f0 + 2, metrics, split),
        edge("used", 10 * n + 5 + fold, aggregate, metrics, "fold-metrics"),
        edge("wasDerivedFrom", 2 * n + fold, total, metrics),
    ]
    return one, each


def run_edges(runs: DataFrame, folds: int = 5) -> DataFrame:
    """All edges, 8 and 24 for each fold, of each run. Edge ids count each relation in the template's order, from
    arithmetic alone: nothing is ranked."""
    one, each = _edge_lists(F.col, folds)
    key = F.col("run_id").alias("doc_id")
    by_fold = runs.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    branches = []
    for rel in RELATIONS:
        for source, edges in ((runs, one), (by_fold, each)):
            own = [e for r, e in edges if r == rel]
            if own:
                branches.append(source.select(key, F.lit(rel).alias("rel"), F.inline(F.array(*own))))
    return reduce(DataFrame.unionByName, branches)


def generate(runs: DataFrame, folds: int = 5, exact: bool = False, real: DataFrame | None = None, environment: dict[str, str] | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of runs that have datasets and a timestamp column ``now``; whole: see ``run_nodes``."""
    results = fold_results(runs, folds, exact, real)
    return run_nodes(runs, results, folds, environment, whole, exact), run_edges(runs, folds)


def run_documents(runs: DataFrame, folds: int = 5, environment: dict[str, str] | None = None, attrs: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole documents as rows: doc_id, copies, ``keep``, an array of nodes (node_id, ptype [, attrs]) for each kind and
    one of edges (edge_id, src, dst, role) for each relation. Each is made from its run alone, so that rules
    about one document need no shuffle of nodes and edges.

    attrs: "json" adds maps of JSON literals, "plain" arrays (key, value) of their texts. Scores are synthetic.
    Runs that share a run_id (copies > 1) become one document that holds the nodes and edges of all, ``keep`` of
    any one of them; only runs, and those documents, are shuffled.
    """
    c = F.col
    key = Window.partitionBy("run_id")
    # A run is a short row that becomes a long one, so that its bytes mustn't decide; each task generates the code anew.
    parts = 2 * runs.sparkSession.sparkContext.defaultParallelism
    runs = runs.repartition(parts, "run_id").withColumn("copies", F.count("*").over(key))
    values: dict[str, Column] = {}
    if attrs:
        base = F.coalesce(c("base_score"), F.lit(0.75))
        train = S.train_size(c("n_samples"))
        for f in range(folds):
            values[f"score_{f}"] = S.native_score(base, c("task_id"), c("cfg_idx"), F.lit(f))
            values |= {f"{name}_{f}": S.stamp(c("now"), 10 * f + shift) for name, shift in _STAMPS.items()}
        runs = runs.withColumns(values | {"train_size": train, "test_size": c("n_samples") - train})
        scores = [c(f"score_{f}") for f in range(folds)]
        mean = sum(scores[1:], scores[0]) / folds
        runs = runs.withColumn("mean", mean)
        deviation = F.sqrt(sum(((x - c("mean")) * (x - c("mean")) for x in scores[1:]), (scores[0] - c("mean")) * (scores[0] - c("mean"))) / folds)
        runs = runs.withColumns({"score_mean": F.bround("mean", 6), "score_std": F.bround(deviation, 6)})

    def node(kind: str, node_id: Column, ptype: str, label: Column | None, *pairs) -> tuple[str, Column]:
        first = [("prov:label", label, TEXT)] if label is not None else []
        made = {"json": _attributes, "plain": _plain_attributes}.get(attrs)
        more = [made(*first, ("prov:type", F.lit(ptype), TEXT), *pairs).alias("attrs")] if made else []
        return kind, F.struct(node_id.alias("node_id"), F.when(F.lit(True), F.lit(ptype)).alias("ptype"), *more)

    def of(f: int) -> Get:
        fixed = {"fold": F.lit(f + 1), "score6": F.bround(c(f"score_{f}"), 6) if attrs else F.lit(0.0)}
        return lambda name: fixed[name] if name in fixed else c(f"{name}_{f}") if name in _STAMPS else c(name)

    nodes = _one_nodes(c, environment, node) + [x for f in range(folds) for x in _fold_nodes(of(f), node)] + [_total_node(c, folds, node)]
    edges = _edge_lists(c, folds)[0] + [x for f in range(folds) for x in _edge_lists(of(f), folds)[1]]
    blocks = [F.array(*[x for k, x in rows if k == name]).alias(name) for names, rows in ((KINDS, nodes), (RELATIONS, edges)) for name in names]
    # A lambda keeps this projection out of whole-stage code, whose one method for all blocks is too long for the JIT.
    doc_id = F.get(F.transform(F.array("run_id"), lambda x: x), F.lit(0)).alias("doc_id")
    made = runs.select(doc_id, "copies", *keep, *blocks)
    shared = made.where("copies > 1").groupBy("doc_id").agg(
        F.first("copies").alias("copies"), *[F.first(k).alias(k) for k in keep], *[F.flatten(F.collect_list(b)).alias(b) for b in (*KINDS, *RELATIONS)]
    )
    return made.where("copies = 1").unionByName(shared)

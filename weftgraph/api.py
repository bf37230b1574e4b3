"""The five public concepts as thin facades over DataFrames, and the evaluation of a corpus."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.model import KINDS, PREFIXES, RELATIONS
from weftgraph.operators import compress, documents, generate, learn, patterns, sample, stats, validate
from weftgraph.operators.validate import CHECKS
from weftgraph.plans import catalog
from weftgraph.sources import corpus, sinks

#: Of so many files at most the names are listed in the driver; samples of larger corpora are drawn by a hash of the name.
MAX_LISTED = 1_000_000
#: Columns of a real fold result.
REAL = ("run_id", "fold", "score", "train_size", "test_size", "train_start", "train_end", "pred_start", "pred_end", "eval_start", "eval_end")
REAL_SCHEMA = "run_id string, fold int, score double, train_size long, test_size long, " + ", ".join(f"{c} string" for c in REAL[5:])


@dataclass(frozen=True)
class CorpusConfig:
    mode: str = "full"
    output_dir: str = "prov_corpus"
    n_folds: int = 5
    random_state: int = 42
    verbose: bool = True
    pretty_print: bool = True
    use_real_execution: bool = False
    validate: bool = False
    validation_checks: tuple[str, ...] = CHECKS
    validation_policy: str = "strict"
    validation_cardinality: bool = True


class ProvDocumentBuilder:
    """One document built by hand; an id that is added again replaces what it had."""

    def __init__(self) -> None:
        self.doc: dict[str, Any] = {"prefix": dict(PREFIXES), **{k: {} for k in (*KINDS, *RELATIONS)}}

    def _element(self, kind: str, node_id: str, attributes: dict[str, Any]) -> None:
        self.doc[kind][node_id] = dict(attributes)

    def _relation(self, rel: str, src: str, dst: str, role: str | None = None) -> None:
        a, b, _, _, letter = RELATIONS[rel]
        block = self.doc[rel]
        block[f"_:{letter}{len(block) + 1}"] = {a: src, b: dst} | ({"prov:role": role} if role else {})

    def add_entity(self, entity_id: str, attributes: dict[str, Any]) -> None:
        self._element("entity", entity_id, attributes)

    def add_activity(self, activity_id: str, attributes: dict[str, Any]) -> None:
        self._element("activity", activity_id, attributes)

    def add_agent(self, agent_id: str, attributes: dict[str, Any]) -> None:
        self._element("agent", agent_id, attributes)

    def add_used(self, activity: str, entity: str, role: str | None = None) -> None:
        self._relation("used", activity, entity, role)

    def add_generation(self, entity: str, activity: str) -> None:
        self._relation("wasGeneratedBy", entity, activity)

    def add_association(self, activity: str, agent: str) -> None:
        self._relation("wasAssociatedWith", activity, agent)

    def add_communication(self, informed: str, informant: str) -> None:
        self._relation("wasInformedBy", informed, informant)

    def add_attribution(self, entity: str, agent: str) -> None:
        self._relation("wasAttributedTo", entity, agent)

    def add_derivation(self, generated: str, used: str) -> None:
        self._relation("wasDerivedFrom", generated, used)

    def graph_stats(self) -> dict[str, int]:
        n = {k: len(self.doc[k]) for k in (*KINDS, *RELATIONS)}
        out = {"nodes": sum(n[k] for k in KINDS), "entities": n["entity"], "activities": n["activity"], "agents": n["agent"]}
        return out | {"edges": sum(n[r] for r in RELATIONS)} | {r: n[r] for r in RELATIONS}

    def to_json(self, pretty: bool = True) -> str:
        return json.dumps(self.doc, indent=2 if pretty else None, default=str)


@dataclass
class ValidationResult:
    valid: bool
    checks: list[dict[str, Any]] = field(default_factory=list)
    summary: str = "ok"

    def as_dict(self) -> dict[str, Any]:
        return {"valid": self.valid, "checks": {c["name"]: {"status": c["status"], "errors": c["errors"]} for c in self.checks}}

    def error_summary(self) -> str:
        return self.summary


class ProvValidator:
    """Checks single documents, or whole tables of them with ``validate_table``."""

    ALL_CHECKS = CHECKS

    def __init__(self, checks: Sequence[str] = CHECKS, expected_cardinality: bool = True, spark: SparkSession | None = None) -> None:
        self.checks, self.cardinality = validate.check_names(checks), expected_cardinality
        self.spark = spark

    def validate_table(self, docs: DataFrame, folds: int = 5) -> DataFrame:
        return validate.validate(docs, self.checks, self.cardinality, folds)

    def validate(self, doc: Any) -> ValidationResult:
        spark = self.spark or SparkSession.builder.getOrCreate()
        row = self.validate_table(spark.createDataFrame([("doc", json.dumps(doc))], "doc_id string, json string")).first()
        return ValidationResult(row["valid"], [c.asDict() for c in row["checks"]], row["summary"])


class CorpusGenerator:
    """Expands a mode's tasks and grids, validates and writes the documents, and reports."""

    def __init__(self, config: CorpusConfig, spark: SparkSession | None = None, client: Any = None) -> None:
        if config.use_real_execution and client is None:
            raise ValueError("real execution needs a task client; none is bundled")
        self.config, self.spark = config, spark or SparkSession.builder.getOrCreate()
        self.client = corpus.TaskClient(client) if client is not None and config.use_real_execution else None

    def get_tasks(self) -> list[tuple[int, str]]:
        live = self.client.suite_task_ids(99) if self.client else None
        return catalog.task_list(self.config.mode, live or None)

    def _runs(self, tasks: list[tuple[int, str]]) -> DataFrame:
        frame = self.spark.createDataFrame([(i, *t) for i, t in enumerate(tasks)], "task_ord int, task_id long, task_type string")
        return generate.expand_runs(frame, catalog.grid_df(self.spark, self.config.mode))

    def execute(self, tasks: list[tuple[int, str]]) -> tuple[list[tuple], dict[int, dict]]:
        """Every run of the tasks, through the client: rows of ``REAL`` and the datasets of tasks with a real run. A task
        that can't be had or is of another type, and a run that fails, have none and stay synthetic."""
        rows, datasets = [], {}
        runs: dict[tuple[int, str], list] = {}
        for r in self._runs(tasks).select("run_id", "task_id", "task_type", "model", "params_json").collect():  # at most 76,032
            runs.setdefault((r["task_id"], r["task_type"]), []).append(r)
        for (task_id, task_type), todo in runs.items():
            try:
                task = self.client.task(task_id)
                learn.validate_task_type(task.task_type, task_type)
                df, name = corpus.task_table(self.spark, task, task_type, self.config.n_folds)
            except Exception as error:  # noqa: BLE001
                print(f"    SKIP task {task_id}: {error}; using synthetic data")
                continue
            df = df.persist()
            for r in todo:
                done = learn.execute_or_none(df, "target", task_type, r["model"], json.loads(r["params_json"]), self.config.n_folds, dataset_id=task.dataset_id, name=name)
                if done is not None:
                    datasets[task_id] = done["dataset_meta"]
                    rows += [(r["run_id"], k, *(x[c] for c in REAL[2:])) for k, x in enumerate(done["fold_results"], 1)]
            df.unpersist()
        return rows, datasets

    def tables(
        self, max_tasks: int | None = None, exact: bool = True, real: DataFrame | None = None, datasets: dict[int, dict] | None = None
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(runs, nodes, edges). datasets: metadata that replaces the synthetic one, by task."""
        c, tasks = self.config, self.get_tasks()[: max_tasks or None]
        runs = generate.with_datasets(self._runs(tasks), generate.synthetic_datasets(self.spark, tasks, datasets))
        runs = runs.withColumn("now", F.lit(S.now_text()).cast("timestamp"))
        nodes, edges = generate.generate(runs, c.n_folds, exact, real, S.environment(), whole=True)
        return runs, nodes, edges

    def generate(self, max_tasks: int | None = None, exact: bool = True) -> dict:
        """Writes the corpus, its manifest and, if validating, the conformance report; returns the statistics."""
        c = self.config
        tasks = self.get_tasks()[: max_tasks or None]
        say = print if c.verbose else lambda *_: None
        say(f"{c.mode} mode: {len(tasks)} tasks, {catalog.expected_runs(tasks, c.mode):,} runs -> {c.output_dir}")
        rows, datasets = self.execute(tasks) if self.client else ([], {})
        real = self.spark.createDataFrame(rows, REAL_SCHEMA) if rows else None
        runs, nodes, edges = self.tables(max_tasks, exact, real, datasets)
        held = [t.persist() for t in (runs, nodes, edges)]  # read by the writer, the checks and the statistics
        docs = documents.to_documents(nodes, edges).persist()
        out, report = Path(c.output_dir), None
        if c.validate:
            outcomes = validate.validate(docs, c.validation_checks, c.validation_cardinality).persist()
            docs = validate.gate(docs, outcomes, c.validation_policy)
            report = validate.report(outcomes, c.validation_policy, c.validation_checks)
        labelled = docs.join(runs.select(F.col("run_id").alias("doc_id"), "task_id", "model"), "doc_id")
        written = sinks.write_files(labelled, str(out), c.pretty_print).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        kept = docs.select("doc_id")
        each = stats.document_stats(nodes.join(kept, "doc_id", "left_semi"), edges.join(kept, "doc_id", "left_semi"))
        graph = stats.corpus_stats(each).first().asDict()
        edge_n = each.agg(*[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in RELATIONS]).first().asDict()
        n_clf = sum(t == catalog.CLASSIFICATION for _, t in tasks)
        found = {
            "total_runs": written["n"], "total_files": written["n"], "total_bytes": written["bytes"], "tasks_processed": len(tasks),
            "classification_tasks": n_clf, "regression_tasks": len(tasks) - n_clf, "real_execution": bool(rows),
            "graph_structure": {f"{m}_per_graph": {k: graph[f"{m}_{k}"] for k in ("min", "max", "total", "avg")} for m in stats.MEASURES} | {"edge_breakdown": edge_n},
        }
        if self.client:
            found["real_runs"] = len({r[0] for r in rows})
        extended = {"large": len(catalog.EXTENDED), "full": len(catalog.EXTENDED_FULL)}.get(c.mode, 0)
        sources = {"CC18": len(catalog.CURATED), "extended_classification": extended, "regression": len(catalog.REGRESSION_TASKS) if c.mode == "full" else 0}
        sinks.write_json(sinks.manifest(c.mode, found, sources), out / "corpus_manifest.json")
        if report is not None:
            sinks.write_json(report, out / "conformance_report.json")
            say(f"validated {report['documents_validated']:,}: {report['documents_passed']:,} passed, {report['documents_failed']:,} failed ({c.validation_policy})")
        for t in (*held, docs):
            t.unpersist()
        say(f"{found['total_runs']:,} runs, {found['total_bytes'] / 2**20:.1f} MB; edges: {edge_n}")
        return found


def evaluate(spark: SparkSession, corpus_dir: str, label: str | None = None, sample_n: int | None = None, outdir: str = "eval_results", seed: int = 42, verbose: bool = True) -> dict:
    """Compression of a corpus, and the pattern queries over (a sample of) it; writes JSON, LaTeX and plots."""
    label = label or Path(corpus_dir).name
    listed = corpus.list_paths(spark, corpus_dir)
    n_paths = listed.count()
    if not n_paths:
        raise SystemExit(f"No prov_*.json files found under {corpus_dir}")
    codecs = {r["codec"]: r for r in compress.single_stream(corpus.read_bytes(spark, corpus_dir)).collect()}
    first = next(iter(codecs.values()))
    keep = ("compressed_bytes", "ratio", "space_saving_pct", "seconds")
    compression = {"raw_bytes": first["raw_bytes"], "n_files": first["n_files"], "codecs": {k: {x: r[x] for x in keep} for k, r in codecs.items()}}
    n_picked = n_paths if sample_n is None else min(sample_n, n_paths)
    docs = corpus.read_documents(spark, corpus_dir).select("path", F.col("path").alias("doc_id"), "json")
    if n_picked < n_paths <= MAX_LISTED:  # as Python draws them, from a list of bounded length
        picked = sample.sample_paths([r["path"] for r in listed.collect()], sample_n, seed)
        docs = docs.join(spark.createDataFrame([(p,) for p in picked], "path string"), "path", "left_semi")
    elif n_picked < n_paths:
        docs = docs.join(sample.exact_n(listed, n_picked, "path"), "path", "left_semi")
    begin = time.perf_counter()
    nodes, edges = (t.persist() for t in documents.to_tables(docs.select("doc_id", "json")))
    n = patterns.triples(nodes, edges).count()
    spent = time.perf_counter() - begin
    loading = {
        "skipped": False, "files_loaded": n_picked, "files_total": n_paths, "triples": n, "load_seconds": round(spent, 3),
        "triples_per_file": round(n / n_picked, 1), "load_seconds_per_file": round(spent / n_picked, 4),
    }
    queries = []
    for name, (text, query) in patterns.QUERIES.items():
        begin = time.perf_counter()
        rows, value = patterns.summarise(query(nodes, edges))
        queries.append({"id": name, "description": text, "result_rows": rows, "result_value": value, "seconds": round(time.perf_counter() - begin, 4)})
    nodes.unpersist()
    edges.unpersist()
    results = {"label": label, "corpus_dir": str(corpus_dir), "n_runs": n_paths, "compression": compression, "queries": {"loading": loading, "queries": queries}}
    written = [sinks.write_json(results, Path(outdir) / f"eval_{label}.json"), *sinks.write_latex(results, label, outdir), *sinks.write_plots(results, label, outdir)]
    if verbose:
        for k, c in compression["codecs"].items():
            print(f"{k:5s} {c['compressed_bytes'] / 1e6:8.2f} MB  {c['ratio']:6.2f}x")
        for q in queries:
            print(f"{q['id']:22s} {q['result_rows']} rows, value {q['result_value']} ({q['seconds'] * 1000:.1f} ms)")
        print("wrote", *written)
    return results

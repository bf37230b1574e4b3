"""Statistics of single graphs and of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.model import RELATIONS

MEASURES = ("nodes", "edges", "entities", "activities", "agents")


def document_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, nodes, entities, activities, agents, edges and one count for each relation. A node id counts once in
    a document; a document without edges has zeros."""
    kinds = {"entities": "entity", "activities": "activity", "agents": "agent"}
    once = nodes.groupBy("doc_id", "kind", "node_id").agg(F.lit(1).alias("x"))
    n = once.groupBy("doc_id").agg(F.count("*").alias("nodes"), *[F.count_if(F.col("kind") == k).alias(name) for name, k in kinds.items()])
    e = edges.groupBy("doc_id").agg(F.count("*").alias("edges"), *[F.count_if(F.col("rel") == r).alias(r) for r in RELATIONS])
    joined = n.join(e, "doc_id", "left")
    return joined.select("doc_id", "nodes", *kinds, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", *RELATIONS)])


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: total_runs and min, max, total, avg of each measure. An empty corpus has zeros."""
    out = [F.count("*").alias("total_runs")]
    for m in MEASURES:
        for name, f in (("min", F.min(m)), ("max", F.max(m)), ("total", F.sum(m))):
            out.append(F.coalesce(f, F.lit(0)).cast("long").alias(f"{m}_{name}"))
        out.append(F.coalesce(F.bround(F.avg(m), 2), F.lit(0.0)).alias(f"{m}_avg"))
    return stats.agg(*out)


def edge_breakdown(edges: DataFrame) -> DataFrame:
    """rel, n."""
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


def corpus_counters(runs: DataFrame, documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: total_runs, total_files, total_bytes; tasks count as listed, twice if listed twice."""
    a = runs.agg(F.count("*").alias("total_runs"))
    b = documents.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(F.octet_length("json")), F.lit(0)).alias("total_bytes"))
    t = tasks.agg(
        F.count("*").alias("tasks_processed"), F.count_if(F.col("task_type") == "classification").alias("classification_tasks"),
        F.count_if(F.col("task_type") != "classification").alias("regression_tasks"),
    )
    return a.crossJoin(b).crossJoin(t)  # one row each

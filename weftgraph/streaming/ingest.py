"""Continuous ingest: documents that arrive in a folder go through the same validator and gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import documents, validate


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, checks: Sequence[str] = validate.CHECKS, policy: str = "strict", cardinality: bool = True):
    """Starts a file stream: each micro-batch is validated, gated and appended to ``output`` as nodes, edges and
    outcomes. A batch that is run again after a failure overwrites its own folder, so nothing is doubled."""
    source = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "prov_*.json").text(folder, wholetext=True)
    source = source.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json"))

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        outcomes = validate.validate(df, checks, cardinality)
        outcomes.write.mode("overwrite").parquet(f"{output}/outcomes/batch={number}")
        outcomes = df.sparkSession.read.parquet(f"{output}/outcomes/batch={number}")
        nodes, edges = documents.to_tables(validate.gate(df, outcomes, policy))
        nodes.write.mode("overwrite").parquet(f"{output}/nodes/batch={number}")
        edges.write.mode("overwrite").parquet(f"{output}/edges/batch={number}")
        df.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

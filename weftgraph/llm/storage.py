"""Intermediate tables in the folder that driver and executors share.

A table written as Parquet cuts the lineage: a lost executor costs a re-read, not a
re-computation, and later readers prune columns.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a session of one machine gets a temporary one; on a
    cluster that is an error, as executors don't share local folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def lean_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Rows of texts go to Python in batches of at most ``rows`` and about ``size`` bytes from now on: at Spark's own
    10,000 rows, the buffers of a batch on both sides follow the length of the texts. Spark reads the settings when
    a plan runs, so they outlast the call that returns the plan; smaller ones of the caller stay."""
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < as_bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step reads."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def without(docs: DataFrame, ids: DataFrame, broadcast_ids: int = 500_000) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids`` (distinct doc_id). Ids (8 bytes each) are broadcast up to a number,
    so that texts aren't shuffled; beyond it both sides are."""
    ids = materialise(ids, "rejected")
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already; the folder's owner cleans it
            return

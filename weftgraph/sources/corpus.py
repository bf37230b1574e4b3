"""Reading corpora and tasks."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = r"task_([^/]+)/([^/]+)/(prov_[^/]+\.json)$"


def read_documents(spark: SparkSession, corpus: str) -> DataFrame:
    """path, task_id, model, doc_id, json: every prov_*.json below a folder, one row a file; other files are skipped."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "prov_*.json").text(corpus, wholetext=True)
    path = F.col("_metadata.file_path")
    rows = rows.select(path.alias("path"), F.col("value").alias("json"))
    part = lambda i: F.nullif(F.regexp_extract("path", PATH, i), F.lit(""))
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return rows.select("path", part(1).cast("long").alias("task_id"), part(2).alias("model"), name.alias("doc_id"), "json")


def read_bytes(spark: SparkSession, corpus: str) -> DataFrame:
    """path, length, content of the same files, as bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "prov_*.json").load(corpus)
    return rows.select("path", "length", "content")


def list_paths(spark: SparkSession, corpus: str) -> DataFrame:
    """Sorted paths of a corpus; no file is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "prov_*.json").load(corpus)
    return rows.select("path").orderBy("path")


class UnsupportedTask(ValueError):
    """A task that can't be run here."""


def with_retries(call: Callable[[], Any], retries: int, delay: float, transient: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError, OSError), sleep: Callable[[float], None] = time.sleep) -> Any:
    """call(), again after delay * 2^n seconds where it fails in a transient way; the last such error is raised.
    NotImplementedError becomes UnsupportedTask; other errors are raised at once."""
    for n in range(retries):
        try:
            return call()
        except NotImplementedError as error:
            raise UnsupportedTask(str(error)) from error
        except transient:
            if n == retries - 1:
                raise
            sleep(delay * 2**n)
    raise ValueError("retries must be at least 1")


class TaskClient:
    """Fetches suites and tasks through a client object with get_suite(id) and get_task(id); none is built in."""

    def __init__(self, client: Any, sleep: Callable[[float], None] = time.sleep) -> None:
        self.client, self.sleep = client, sleep

    def suite_task_ids(self, suite_id: int, retries: int = 3, delay: float = 5.0) -> list[int] | None:
        """Task ids of a suite, or None if it can't be had."""
        try:
            return list(with_retries(lambda: self.client.get_suite(suite_id), retries, delay, (Exception,), self.sleep))
        except Exception:  # noqa: BLE001
            return None

    def task(self, task_id: int, retries: int = 5, delay: float = 10.0) -> Any:
        return with_retries(lambda: self.client.get_task(task_id), retries, delay, sleep=self.sleep)


def task_table(spark: SparkSession, task: Any, task_type: str, folds: int) -> tuple[DataFrame, str]:
    """Features f0, f1, ..., target and fold (0-based, repeat 0 of the task's own splits; -1: in no test fold), and the
    dataset's name. The client's data is a pandas frame in the driver. Classes are coded by their sorted names."""
    dataset = task.get_dataset()
    x, y, _, _ = dataset.get_data(target=task.target_name, dataset_format="dataframe")
    fold = [-1] * len(x)
    for k in range(folds):
        train, test = (set(map(int, i)) for i in task.get_train_test_split_indices(fold=k, repeat=0))
        if train & test or len(train) + len(test) != len(x) or any(fold[i] >= 0 for i in test):
            raise UnsupportedTask(f"fold {k} is not one of a cross-validation")
        for i in test:
            fold[i] = k
    columns, types = [], []
    for name in x.columns:
        number = x[name].dtype.kind in "iuf"
        missing = x[name].isna().tolist()
        columns.append([None if m else float(v) if number else str(v) for v, m in zip(x[name].tolist(), missing, strict=True)])
        types.append("double" if number else "string")
    target = list(y)
    if task_type == "classification":
        code = {v: float(i) for i, v in enumerate(sorted(set(target), key=str))}
        target = [code[v] for v in target]
    rows = list(zip(*columns, map(float, target), fold, strict=True))
    schema = ", ".join([*(f"f{i} {t}" for i, t in enumerate(types)), "target double", "fold int"])
    return spark.createDataFrame(rows, schema), dataset.name


def load_env_file(path: str | Path) -> dict[str, str]:
    """KEY=value lines of an .env file; variables that are set already win. Values are never printed."""
    found = {}
    p = Path(path)
    if p.exists():
        for line in p.read_text().splitlines():
            m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
            if m:
                found[m[1]] = os.environ.setdefault(m[1], m[2].strip("'\""))
    return found


def with_folds(df: DataFrame, key: str, folds: int, given: str | None = None) -> DataFrame:
    """Adds fold (0-based): a given column, or a hash of the key."""
    return df.withColumn("fold", F.col(given).cast("int") if given else F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))

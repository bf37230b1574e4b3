"""Scalar functions of the generator, as columns where Spark has them and as Arrow UDFs where results must equal
Python's own to the last digit."""

from __future__ import annotations

import hashlib
import json
import platform
import random
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STAMP = "%Y-%m-%dT%H:%M:%SZ"


def json_string(c: Column) -> Column:
    """A string column as a JSON literal."""
    quoted = F.to_json(F.array(c.cast("string")))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def sha256_of_string(c: Column) -> Column:
    """sha256 of the JSON literal of a string, as hex (ASCII texts)."""
    return F.sha2(F.concat(F.lit('"'), c, F.lit('"')), 256)


def sha256_of(data: object) -> str:
    """sha256 of bytes, or of the canonical JSON of anything else."""
    raw = data if isinstance(data, bytes) else json.dumps(data, sort_keys=True, default=str).encode()
    return hashlib.sha256(raw).hexdigest()


def new_run_id() -> str:
    return uuid.uuid4().hex


def run_id(*parts: Column) -> Column:
    """A deterministic run id: the same parts give the same id in every run and engine."""
    return F.substr(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(1), F.lit(32))


def stamp(now: Column, seconds: Column | int = 0) -> Column:
    """A timestamp shifted by seconds, in UTC as text (session time zone UTC)."""
    shifted = F.timestamp_seconds(F.unix_timestamp(now) + (F.lit(seconds) if isinstance(seconds, int) else seconds))
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_stamp(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def now_text(offset_seconds: int = 0) -> str:
    return (datetime.now(timezone.utc) + timedelta(seconds=offset_seconds)).strftime(STAMP)


def train_size(n: Column) -> Column:
    """The 80 % of a dataset that folds train on, cut down to a whole number."""
    return (n * F.lit(0.8)).cast("long")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def environment() -> dict[str, str]:
    """Attributes of the environment entity; two versions are fixed values."""
    return {
        "ml:python_version": platform.python_version(),
        "ml:platform": platform.platform(),
        "ml:sklearn_version": "1.7.1",
        "ml:numpy_version": np.__version__,
        "ml:openml_version": "0.15.1",
    }


def native_score(base: Column, task_id: Column, cfg_idx: Column, fold: Column) -> Column:
    """A bell-shaped score from eight chunks of a sha256 (their sum is nearly normal): computed in the JVM and
    repeatable in SQL. Its numbers are not those of ``exact_score``."""
    h = F.sha2(F.concat_ws("|", task_id.cast("string"), cfg_idx.cast("string"), fold.cast("string")), 256)
    total = sum((F.conv(F.substr(h, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("double") for i in range(8)), F.lit(0.0))
    return clamp(base + (total / float(1 << 32) - 4.0) / float(np.sqrt(8 / 12)) * 0.05)


@F.pandas_udf(DoubleType())
def exact_score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The score that Python's generator gives: (base, task_id, cfg_idx, zero-based fold). The model isn't in the
    seed, so all models share the noise of a task, configuration and fold."""
    rng = random.Random()
    for base, task, cfg, fold in batches:
        out = []
        for b, t, c, f in zip(base, task, cfg, fold, strict=True):
            rng.seed(int(t) * 1000 + int(c) * 10 + int(f))
            out.append(max(0.0, min(1.0, b + rng.gauss(0, 0.05))))
        yield pd.Series(out)


def python_round(digits: int):
    """Python's rounding, which looks at the exact binary value (neither round nor bround of Spark does)."""

    @F.pandas_udf(DoubleType())
    def rounded(c: pd.Series) -> pd.Series:
        return c.map(lambda x: x if x is None or x != x else round(float(x), digits))

    return rounded


def dataset_info(task_id: int, task_type: str) -> dict:
    """A synthetic dataset's properties; the draws are in this order."""
    from weftgraph.plans.catalog import CLASSIFICATION, DATASET_NAMES

    rng = random.Random(task_id)
    clf = task_type == CLASSIFICATION
    name = rng.choice(DATASET_NAMES[task_type]).format(task_id)
    samples, features = rng.randint(500, 50000), rng.randint(10, 500)
    return {
        "dataset_id": task_id, "dataset_name": name, "n_samples": samples, "n_features": features,
        "n_classes": rng.randint(2, 10) if clf else None, "task_type": task_type, "metric": "accuracy" if clf else "r2_score",
    }


def tex_escape(s: str) -> str:
    return s.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")


def split_names(text: str) -> tuple[str, ...]:
    """A comma-separated list, stripped, without empty parts."""
    return tuple(x.strip() for x in text.split(",") if x.strip())

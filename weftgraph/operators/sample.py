"""Exact-size samples and ordered limits."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_n(df: DataFrame, n: int | None, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, repeatable: the n smallest of a salted hash of the key. All rows if there are no
    more, or if n is None."""
    if n is None:
        return df
    h = F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string")), 256)
    return df.orderBy(h, key).limit(n)


def sample_paths(paths: list[str], n: int | None, seed: int = 42) -> list[str]:
    """The members that Python's generator picks from a sorted list of paths (a list of the driver)."""
    return list(paths) if n is None or n >= len(paths) else random.Random(seed).sample(list(paths), n)


def first_n(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows by explicit order; 0 or None for all."""
    return df.orderBy(*order).limit(n) if n else df

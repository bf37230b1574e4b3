"""Estimators that Spark ML lacks, with its interface: fit(train) gives a model whose transform(df) adds ``prediction``.

Both frames have ``features`` (a vector) and ``label`` (double).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A training table goes to the tasks that look for neighbours if it has at most so many numbers (64 MB).
NEIGHBOUR_CELLS = 8 << 20


class Neighbours:
    """The k nearest training rows by Euclidean or Manhattan distance: a majority (of equal ones the smallest label) or a
    mean, plain or weighted by the inverse distance. Larger training tables than NEIGHBOUR_CELLS are an error."""

    def __init__(self, classify: bool, n_neighbors: int = 5, weights: str = "uniform", metric: str = "minkowski", **_: Any) -> None:
        self.classify, self.k, self.by_distance, self.manhattan = classify, n_neighbors, weights == "distance", metric == "manhattan"

    def fit(self, train: DataFrame) -> NeighbourModel:
        width = len(train.first()["features"])
        n = train.count()
        if n * (width + 1) > NEIGHBOUR_CELLS:
            raise ValueError(f"{n} training rows of {width} features are too many to search for neighbours")
        rows = train.select(vector_to_array("features").alias("x"), "label").toPandas()
        return NeighbourModel(self, np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(float))


class NeighbourModel:
    def __init__(self, of: Neighbours, x: np.ndarray, y: np.ndarray) -> None:
        self.of, self.x, self.y = of, x, y

    def predict(self, asked: np.ndarray) -> np.ndarray:
        out = np.zeros(len(asked))
        step = max(1, (1 << 21) // max(1, self.x.size))
        for lo in range(0, len(asked), step):
            gap = asked[lo : lo + step, None, :] - self.x[None]
            far = np.abs(gap).sum(2) if self.of.manhattan else np.sqrt((gap * gap).sum(2))
            near = np.argsort(far, axis=1, kind="stable")[:, : self.of.k]
            d, y = np.take_along_axis(far, near, 1), self.y[near]
            w = np.ones_like(d)
            if self.of.by_distance:
                same = d == 0
                w = np.where(same.any(1, keepdims=True), same, 1 / np.where(same, 1, d))
            if self.of.classify:
                labels = np.unique(self.y)
                out[lo : lo + step] = labels[np.stack([(w * (y == v)).sum(1) for v in labels], 1).argmax(1)]
            else:
                out[lo : lo + step] = (w * y).sum(1) / w.sum(1)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in parts:
                yield pd.Series(self.predict(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        return df.withColumn("prediction", nearest(vector_to_array("features")))


class AdaBoost:
    """Boosting by reweighted rows: votes of stumps (SAMME) for classes, the weighted median of trees (R2, linear loss) for
    numbers. A member is a tree that Spark fits on the row weights; the rows' weights are a product of the members'
    verdicts and never leave the executors."""

    def __init__(self, classify: bool, n_classes: int | None = None, n_estimators: int = 50, learning_rate: float = 1.0, random_state: int = 42, **_: Any) -> None:
        self.classify, self.n_classes, self.rounds, self.rate, self.seed = classify, n_classes or 2, n_estimators, learning_rate, random_state

    def fit(self, train: DataFrame) -> AdaBoostModel:
        kind = DecisionTreeClassifier if self.classify else DecisionTreeRegressor
        tree = kind(maxDepth=1 if self.classify else 3, weightCol="w", seed=self.seed)
        rows = train.select("features", "label").withColumn("w", F.lit(1.0))
        members: list[tuple[Any, float]] = []
        for _ in range(self.rounds):
            held = rows.persist()
            model = tree.fit(held)
            said = model.transform(held)
            gap = (F.col("prediction") != F.col("label")).cast("double") if self.classify else F.abs(F.col("prediction") - F.col("label"))
            total = said.agg(F.sum("w").alias("w"), F.sum(F.col("w") * gap).alias("e"), F.max(gap).alias("most")).first()
            scale = 1.0 if self.classify else total["most"] or 1.0
            error = total["e"] / total["w"] / scale
            if error <= 0:  # a perfect member decides alone
                held.unpersist()
                return AdaBoostModel(self, [(model, 1.0)])
            if error >= (1 - 1 / self.n_classes if self.classify else 0.5):
                held.unpersist()
                members = members or [(model, 1.0)]
                break
            beta = error / (1 - error)
            weight = self.rate * ((math.log(1 / beta) + math.log(self.n_classes - 1)) if self.classify else math.log(1 / beta))
            members.append((model, weight))
            new = F.col("w") * F.exp(weight * gap) if self.classify else F.col("w") * F.pow(F.lit(beta), self.rate * (1 - gap / scale))
            rows = said.select("features", "label", new.alias("w"))
            if len(members) % 10 == 0 and train.sparkSession.conf.get("spark.checkpoint.dir", None):
                rows = rows.checkpoint()  # the plan grows by a tree a round
            held.unpersist()
        return AdaBoostModel(self, members)


class AdaBoostModel:
    def __init__(self, of: AdaBoost, members: list[tuple[Any, float]]) -> None:
        self.of, self.members = of, members

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("said", F.array().cast("array<struct<value: double, weight: double>>"))
        for model, weight in self.members:
            one = F.struct(F.col("prediction").alias("value"), F.lit(weight).alias("weight"))
            drop = [c for c in ("rawPrediction", "probability", "prediction") if c in model.transform(out.limit(0)).columns]
            out = model.transform(out).withColumn("said", F.concat("said", F.array(one))).drop(*drop)
        return out.withColumn("prediction", self._vote() if self.of.classify else self._median()).drop("said")

    def _vote(self) -> Column:
        for_class = lambda k: F.aggregate("said", F.lit(0.0), lambda t, s: t + F.when(s["value"] == k.cast("double"), s["weight"]).otherwise(0.0))
        classes = F.transform(F.sequence(F.lit(0), F.lit(self.of.n_classes - 1)), lambda k: F.struct(for_class(k).alias("votes"), (-k).alias("k")))
        return (-F.array_max(classes)["k"]).cast("double")

    def _median(self) -> Column:
        ordered = F.array_sort("said")
        half = sum(w for _, w in self.members) / 2
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("value"))
        step = lambda t, s: F.struct((t["sum"] + s["weight"]).alias("sum"), F.coalesce(t["value"], F.when(t["sum"] + s["weight"] >= half, s["value"])).alias("value"))
        return F.aggregate(ordered, start, step)["value"]

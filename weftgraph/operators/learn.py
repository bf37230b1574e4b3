"""Fold-wise learning: preprocessing fitted on training folds, estimators, and scores.

Statistics are grouped by fold over one pass: what a training split counts is the total less what its test
fold counts, so no data is copied for each fold.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.scalars import STAMP

SUPPORTED = {"classification": "Supervised Classification", "regression": "Supervised Regression"}


def validate_task_type(actual: str, task_type: str) -> None:
    """ValueError if a task isn't of the expected type."""
    if actual != SUPPORTED.get(task_type):
        raise ValueError(f"unsupported type '{actual}' (expected '{SUPPORTED.get(task_type)}')")


def dataset_metadata(df: DataFrame, target: str, task_type: str, dataset_id: int, name: str) -> dict:
    """Rows, feature columns and, for classification, distinct classes of a dataset."""
    row = df.agg(F.count("*").alias("n"), F.countDistinct(target).alias("k")).first()
    clf = task_type == "classification"
    return {
        "dataset_id": dataset_id, "dataset_name": name, "n_samples": row["n"], "n_features": len(df.columns) - 1,
        "n_classes": row["k"] if clf else None, "task_type": task_type, "metric": "accuracy" if clf else "r2_score",
    }


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(numeric, other) column names."""
    names = [f for f in df.schema.fields if f.name not in without]
    number = [f.name for f in names if isinstance(f.dataType, T.NumericType)]
    return number, [f.name for f in names if f.name not in number]


def train_means(df: DataFrame, column: str, fold: str = "fold") -> DataFrame:
    """fold, mean: the mean over all rows of other folds (nulls left out)."""
    part = df.groupBy(fold).agg(F.coalesce(F.sum(column), F.lit(0)).alias("s"), F.count(column).alias("n"))
    everywhere = Window.partitionBy()  # over one row a fold
    return part.select(fold, ((F.sum("s").over(everywhere) - F.col("s")) / F.nullif(F.sum("n").over(everywhere) - F.col("n"), F.lit(0))).alias("mean"))


def train_counts(df: DataFrame, value: str, fold: str = "fold") -> DataFrame:
    """fold, value, n: how often each value occurs outside the fold (nulls left out; n may be 0)."""
    part = df.where(F.col(value).isNotNull()).groupBy(fold, value).agg(F.count("*").alias("n"))
    total = part.groupBy(value).agg(F.sum("n").alias("total"))
    folds = F.broadcast(df.select(fold).distinct())  # one row a fold
    grid = folds.crossJoin(total).join(part, [fold, value], "left")
    return grid.select(fold, value, (F.col("total") - F.coalesce("n", F.lit(0))).alias("n"))


def train_modes(df: DataFrame, value: str, fold: str = "fold") -> DataFrame:
    """fold, mode: the most frequent value outside the fold; of equally frequent ones the smallest."""
    counts = train_counts(df, value, fold).where("n > 0")
    best = counts.groupBy(fold).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct("n")).alias("x"), F.max("n").alias("top"))
    ties = counts.join(best.select(fold, "top"), fold).where("n = top")
    return ties.groupBy(fold).agg(F.min(value).alias("mode"))


def train_codes(df: DataFrame, value: str, fold: str = "fold") -> DataFrame:
    """fold, value, code: ordinal codes from 0 of the sorted values of the training split."""
    seen = train_counts(df, value, fold).where("n > 0")
    return seen.select(fold, value, (F.row_number().over(Window.partitionBy(fold).orderBy(value)) - 1).alias("code"))


def ordinal_encode(df: DataFrame, value: str, codes: DataFrame, fold: str = "fold", unknown: int = -1) -> DataFrame:
    """Adds <value>_code; values that the training split doesn't have get ``unknown``."""
    found = df.join(codes, [fold, value], "left")
    return found.withColumn(f"{value}_code", F.coalesce("code", F.lit(unknown))).drop("code")


def impute(df: DataFrame, value: str, statistics: DataFrame, name: str, fold: str = "fold") -> DataFrame:
    """Fills nulls of a column with its fold's statistic (one row a fold, broadcast)."""
    return df.join(F.broadcast(statistics.select(fold, name)), fold, "left").withColumn(value, F.coalesce(value, name)).drop(name)


def accuracy(y: Column, predicted: Column) -> Column:
    return F.avg(F.when(y == predicted, 1.0).otherwise(0.0))


def r2(df: DataFrame, y: str, predicted: str, by: str) -> DataFrame:
    """by, r2: 1 - residual / total sum of squares; a constant y scores 1 if it is met exactly, else 0."""
    mean = df.groupBy(by).agg(F.avg(y).alias("_mean"))
    rows = df.join(F.broadcast(mean), by)  # one row a fold
    s = rows.groupBy(by).agg(F.sum((F.col(y) - F.col(predicted)) ** 2).alias("res"), F.sum((F.col(y) - F.col("_mean")) ** 2).alias("tot"))
    return s.select(by, F.when(F.col("tot") == 0, F.when(F.col("res") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("res") / F.nullif("tot", F.lit(0.0))).alias("r2"))


def majority_predictions(df: DataFrame, group: str, y: str, fold: str = "fold") -> DataFrame:
    """Adds predicted: the most frequent y (of equals the smallest) of the row's group in the other folds."""
    key = df.withColumn("_k", F.struct(group, y))
    n = train_counts(key, "_k", fold).where("n > 0").select(fold, F.col(f"_k.{group}").alias(group), F.col(f"_k.{y}").alias("_y"), "n")
    best = n.groupBy(fold, group).agg(F.min_by("_y", F.struct(-F.col("n"), F.col("_y"))).alias("predicted"))
    return df.join(best, [fold, group], "left")


def mean_predictions(df: DataFrame, group: str, y: str, fold: str = "fold") -> DataFrame:
    """Adds predicted: the mean y of the row's group in the other folds."""
    part = df.groupBy(fold, group).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    total = part.groupBy(group).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    stats = part.join(total, group).select(fold, group, ((F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))).alias("predicted"))
    return df.join(stats, [fold, group], "left")


def split(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) of a fold."""
    return df.where(F.col(fold) != k), df.where(F.col(fold) == k)


def estimator(model: str, config: dict, n_features: int, n_classes: int | None):
    """The Spark estimator of a model name, with the parameters that both sides know. Extra trees are forests of whole
    samples, whose cuts aren't random; bagging is a forest that may use all features at each cut; histogram boosting is
    Spark's boosting, which bins features anyway. Support vectors with other kernels than the linear one raise
    NotImplementedError; unknown names ValueError. Scores need not equal another library's."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    from weftgraph.operators.ensembles import AdaBoost, Neighbours

    depth = min(config.get("max_depth") or 30, 30)
    seed = config.get("random_state", 42)
    forest = {"numTrees": config.get("n_estimators", 100), "maxDepth": depth, "seed": seed}
    boost = {"maxIter": config.get("n_estimators", 100), "stepSize": config.get("learning_rate", 0.1), "maxDepth": min(config.get("max_depth") or 3, 30), "seed": seed}
    whole = forest | {"bootstrap": config.get("bootstrap", False), "subsamplingRate": 1.0}
    bags = {"numTrees": config.get("n_estimators", 10), "maxDepth": 30, "seed": seed, "subsamplingRate": config.get("max_samples", 1.0), "featureSubsetStrategy": str(config.get("max_features", "all"))}
    bins = {"maxIter": config.get("max_iter", 100), "stepSize": config.get("learning_rate", 0.1), "maxDepth": config.get("max_depth") or 5, "maxBins": 255, "seed": seed}
    make: dict[str, Callable] = {
        "ExtraTrees": lambda: C.RandomForestClassifier(**whole),
        "BaggingClassifier": lambda: C.RandomForestClassifier(**bags),
        "HistGradientBoosting": lambda: C.GBTClassifier(**bins) if n_classes == 2 else C.OneVsRest(classifier=C.GBTClassifier(**bins)),
        "KNN": lambda: Neighbours(True, **config),
        "AdaBoost": lambda: AdaBoost(True, n_classes, **config),
        "ExtraTreesRegressor": lambda: R.RandomForestRegressor(**whole),
        "HistGradientBoostingRegressor": lambda: R.GBTRegressor(**bins),
        "KNeighborsRegressor": lambda: Neighbours(False, **config),
        "AdaBoostRegressor": lambda: AdaBoost(False, **config),
        "MLPRegressor": lambda: _missing("MLPRegressor"),
        "SVR": lambda: _missing("SVR"),
        "RandomForest": lambda: C.RandomForestClassifier(**forest),
        "GradientBoosting": lambda: C.GBTClassifier(**boost) if n_classes == 2 else C.OneVsRest(classifier=C.GBTClassifier(**boost)),
        "LogisticRegression": lambda: C.LogisticRegression(regParam=1.0 / config.get("C", 1.0) / 1000, maxIter=config.get("max_iter", 100)),
        "SVM": lambda: _linear_svm(C, config, n_classes),
        "MLP": lambda: C.MultilayerPerceptronClassifier(layers=[n_features, *config.get("hidden_layer_sizes", (100,)), n_classes or 2], maxIter=config.get("max_iter", 100), seed=seed),
        "DecisionTree": lambda: C.DecisionTreeClassifier(maxDepth=depth, seed=seed),
        "NaiveBayes": lambda: C.NaiveBayes(modelType="gaussian", smoothing=config.get("var_smoothing", 1e-9)),
        "RandomForestRegressor": lambda: R.RandomForestRegressor(**forest),
        "GradientBoostingRegressor": lambda: R.GBTRegressor(**boost),
        "DecisionTreeRegressor": lambda: R.DecisionTreeRegressor(maxDepth=depth, seed=seed),
        "Ridge": lambda: R.LinearRegression(regParam=config.get("alpha", 1.0), elasticNetParam=0.0),
        "Lasso": lambda: R.LinearRegression(regParam=config.get("alpha", 1.0), elasticNetParam=1.0, maxIter=config.get("max_iter", 1000)),
        "ElasticNet": lambda: R.LinearRegression(regParam=config.get("alpha", 1.0), elasticNetParam=config.get("l1_ratio", 0.5), maxIter=config.get("max_iter", 1000)),
    }
    if model in make:
        return make[model]()
    raise ValueError(f"Unknown model '{model}'. Available: {sorted(make)}")


def _missing(model: str):
    raise NotImplementedError(f"there is no {model} on Spark")


def _linear_svm(classifiers, config: dict, n_classes: int | None):
    if config.get("kernel", "rbf") != "linear":
        raise NotImplementedError("Spark ML has linear SVMs only")
    svm = classifiers.LinearSVC(regParam=1.0 / config.get("C", 1.0) / 1000)
    return svm if n_classes == 2 else classifiers.OneVsRest(classifier=svm)


def preprocess(df: DataFrame, target: str, fold: str = "fold") -> tuple[DataFrame, list[str]]:
    """Fold-wise imputed and encoded features, and their names; other columns are dropped."""
    numbers, others = numeric_columns(df, (target, fold))
    out = df
    for c in numbers:
        out = impute(out.withColumn(c, F.col(c).cast("double")), c, train_means(df, c, fold), "mean", fold)
    for c in others:
        filled = impute(out, c, train_modes(df, c, fold), "mode", fold)
        out = ordinal_encode(filled, c, train_codes(df, c, fold), fold)
    names = [*numbers, *[f"{c}_code" for c in others]]
    return out.select(*names, F.col(target), F.col(fold)), names


def run_fold(prepared: DataFrame, features: list[str], target: str, k: int, task_type: str, est, fold: str = "fold") -> dict:
    """Fit on the other folds, predict and score fold ``k``; stages share their border stamps."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(prepared).select("features", F.col(target).cast("double").alias("label"), fold)
    train, test = split(rows, k, fold)
    n_train, n_test = train.count(), test.count()
    t = [time.time()]
    model = est.fit(train)
    t.append(time.time())
    predicted = model.transform(test).select("label", "prediction", fold).persist()
    predicted.count()  # predictions are made before the second stamp
    t.append(time.time())
    if task_type == "classification":
        score = predicted.agg(accuracy(F.col("label"), F.col("prediction"))).first()[0]
    else:
        score = r2(predicted, "label", "prediction", fold).first()["r2"]
    t.append(time.time())
    predicted.unpersist()
    at = [time.strftime(STAMP, time.gmtime(x)) for x in t]
    return {
        "score": score, "train_size": n_train, "test_size": n_test, "train_start": at[0], "train_end": at[1], "pred_start": at[1],
        "pred_end": at[2], "eval_start": at[2], "eval_end": at[3], "train_duration_s": round(t[1] - t[0], 4), "pred_duration_s": round(t[2] - t[1], 4),
    }


def execute(df: DataFrame, target: str, task_type: str, model: str, config: dict, folds: int = 5, fold: str = "fold", dataset_id: int = 0, name: str = "") -> dict:
    """Cross-validation over a fold column (0-based): dataset_meta and fold_results."""
    meta = dataset_metadata(df.drop(fold), target, task_type, dataset_id, name)
    prepared, features = preprocess(df, target, fold)
    prepared = prepared.persist()
    results = [run_fold(prepared, features, target, k, task_type, estimator(model, config, len(features), meta["n_classes"]), fold) for k in range(folds)]
    prepared.unpersist()
    return {"dataset_meta": meta, "fold_results": results}


def execute_or_none(*args, **kwargs) -> dict | None:
    """``execute``, or None with a warning where it fails: such a run falls back to synthetic results. Its dataset then
    stays that of its own task, never that of an earlier run."""
    try:
        return execute(*args, **kwargs)
    except Exception as error:  # noqa: BLE001
        print(f"    WARNING: real execution failed unexpectedly ({error}), falling back to synthetic")
        return None

"""Random forests: fitting, scoring, importances and cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.operators.forest import ForestModel, fit, score
from coreloom.operators.metrics import scores
from coreloom.operators.split import ordered_folds, stratified_folds

MAX_DEPTH = 30


@dataclass(frozen=True)
class Forest:
    """Settings of one forest; an unlimited depth becomes 30."""

    trees: int = 100
    depth: int = MAX_DEPTH
    min_leaf: int = 1
    impurity: str = "gini"
    balanced: bool = True
    seed: int = 42

    def with_trees(self, trees: int) -> "Forest":
        return replace(self, trees=trees)


# The forest settings of the eight workflows, by stage.
FULL_ANOMALY_ENTROPY_PCA = Forest(trees=100, impurity="entropy")
FULL_ANOMALY_ENTROPY_STRATIFIED = Forest(trees=100, min_leaf=6, impurity="entropy")
FULL_ANOMALY_KMEANS_PCA = Forest(trees=100, depth=20, min_leaf=5, impurity="entropy")
FULL_ANOMALY_KMEANS = Forest(trees=100, depth=20, min_leaf=5)
FULL_APPLICATION = Forest(trees=250, depth=20, min_leaf=5, impurity="entropy")
CORE_ANOMALY_ENTROPY_PCA = Forest(trees=150)
CORE_DEEP = Forest(trees=150, depth=20)
CORE_ANOMALY_KMEANS = Forest(trees=100)
COMPRESSED = Forest(trees=100)
COMPRESSED_APPLICATION_ENTROPY_PCA = Forest(trees=150, depth=20)


def fit_forest(df: DataFrame, forest: Forest, label: str = "label") -> ForestModel:
    """Fit on ``features`` arrays and integer class codes 0..C-1; an empty table is an error."""
    if df.isEmpty():
        raise ValueError("no rows to fit a forest on")
    return fit(df, forest, label)


def predict(model: ForestModel, df: DataFrame) -> DataFrame:
    """Add ``probability array<double>`` and ``prediction int``."""
    return score(model, df)


def importances(model: ForestModel, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance), one row per feature, zeros included."""
    values = model.feature_importances()
    return spark.createDataFrame(
        [(names[i], float(v)) for i, v in enumerate(values)], "feature string, importance double"
    )


def top_features(table: DataFrame, n: int = 50) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def importance_difference(full: DataFrame, core: DataFrame, n: int = 10) -> DataFrame:
    """The n features whose importance differs most between two models."""
    joined = full.select("feature", F.col("importance").alias("full_importance")).join(
        core.select("feature", F.col("importance").alias("core_importance")), "feature"
    )
    difference = F.col("full_importance") - F.col("core_importance")
    return (
        joined.withColumn("difference", difference).orderBy(F.abs(difference).desc(), "feature").limit(n)
    )


def cross_validate(
    df: DataFrame, forest: Forest, k: int = 5, seed: int = 42, label: str = "label", key: str = "row_id", shuffled: bool = True
) -> DataFrame:
    """(fold, accuracy, f1): refit on k-1 folds, score the one left out; empty folds drop out.

    Folds are in seeded md5 order of ``key``, or, unshuffled, runs in the order of ``key``.
    """
    folded = (stratified_folds(df, k, label, key, seed) if shuffled else ordered_folds(df, k, label, key)).persist()
    try:
        results = []
        for fold in range(k):
            model = fit_forest(folded.where(F.col("fold") != fold), forest, label)
            held = predict(model, folded.where(F.col("fold") == fold))
            row = scores(held, label).first()
            if row["accuracy"] is not None:
                results.append((fold, float(row["accuracy"]), float(row["f1"])))
    finally:
        folded.unpersist()
    return df.sparkSession.createDataFrame(results, "fold int, accuracy double, f1 double")


def cv_summary(folds: DataFrame, *by: str) -> DataFrame:
    """Mean and population standard deviation over the folds."""
    return folds.groupBy(*by).agg(
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("f1").alias("f1_mean"),
        F.stddev_pop("f1").alias("f1_std"),
    )

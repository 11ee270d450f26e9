"""Principal components of feature arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.operators.bounded import small_rows
from coreloom.operators.features import MAX_FEATURES, center, moments, to_long


@dataclass
class Components:
    """A centred PCA: all components are fitted once, ``k`` of them are used."""

    means: list[float]
    model: PCAModel
    explained: list[float]
    k: int

    def transform(self, df: DataFrame, k: int | None = None, single: bool = False) -> DataFrame:
        """Replace ``features`` by the first k component scores."""
        vectors = center(df, self.means).withColumn("_vector", array_to_vector("features"))
        scores = F.slice(vector_to_array("_pcs"), 1, k or self.k)
        scored = self.model.transform(vectors).withColumn("features", scores).drop("_vector", "_pcs")
        return scored.withColumn("features", F.col("features").cast("array<float>")) if single else scored

    def needed(self, share: float) -> int:
        """Smallest number of components whose cumulative share reaches ``share``."""
        total = 0.0
        for i, v in enumerate(self.explained):
            total += v
            if total >= share:
                return i + 1
        return len(self.explained)

    def variance_table(self, spark: SparkSession) -> DataFrame:
        """(component 1.., explained, cumulative)."""
        rows, total = [], 0.0
        for i, v in enumerate(self.explained):
            total += v
            rows.append((i + 1, v, total))
        return spark.createDataFrame(rows, "component int, explained double, cumulative double")


def fit_pca(df: DataFrame, share: float | None = 0.95, k: int | None = None) -> Components:
    """PCA of ``features``; ``k`` fixed, or the fewest components explaining ``share``.

    Spark's PCA projects without centring, so the column means are subtracted first.
    """
    rows = small_rows(moments(to_long(df)), MAX_FEATURES, "features")
    rows.sort(key=lambda r: r["feature"])
    means = [r["mean"] for r in rows]
    count = rows[0]["n"]
    width = min(count, len(means)) if k is None else min(k, len(means))
    vectors = center(df, means).select(array_to_vector("features").alias("_vector"))
    model = PCA(k=width, inputCol="_vector", outputCol="_pcs").fit(vectors)
    fitted = Components(means, model, [float(v) for v in model.explainedVariance.toArray()], width)
    if k is None and share is not None:
        fitted.k = fitted.needed(share)
    return fitted

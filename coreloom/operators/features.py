"""Feature arrays: assembling, moments, population scaling, variance filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreloom.functions.scalars import pick
from coreloom.operators.bounded import small_rows

MAX_FEATURES = 100_000


def assemble(df: DataFrame, columns: Sequence[str], null_policy: str = "error") -> DataFrame:
    """Replace the given columns by one ``features array<double>``.

    ``null_policy``: ``error`` fails on the first null cell, ``skip`` drops rows with
    one, ``mean`` fills with the column mean of ``df``, ``keep`` leaves null cells for
    :func:`fill_cells`.
    """
    cells = [F.col(f"`{c}`").cast("double") for c in columns]
    if null_policy == "mean":
        means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)]).first()
        cells = [F.coalesce(c, F.lit(means[i] if means[i] is not None else 0.0)) for i, c in enumerate(cells)]
    features = F.array(*cells)
    if null_policy == "skip":
        df = df.where(~F.exists(features, lambda x: x.isNull()))
    elif null_policy == "error":
        broken = F.exists(features, lambda x: x.isNull())
        features = F.when(broken, F.raise_error(F.lit("null feature cell")).cast("array<double>")).otherwise(features)
    elif null_policy not in ("mean", "keep"):
        raise ValueError(f"unknown null policy {null_policy}")
    rest = [c for c in df.columns if c not in set(columns)]
    return df.select(*rest, features.alias("features"))


def cell_means(df: DataFrame) -> DataFrame:
    """One row, ``_means``: the mean of each feature over its known cells (0 if it has none)."""
    known = moments(to_long(df)).select("feature", F.coalesce("mean", F.lit(0.0)).alias("mean"))
    listed = known.agg(F.array_sort(F.collect_list(F.struct("feature", "mean"))).alias("_m"))
    return listed.select(F.transform("_m", lambda c: c["mean"]).alias("_means"))


def fill_cells(df: DataFrame, means: DataFrame) -> DataFrame:
    """Put the means (one row, see :func:`cell_means`) into null feature cells."""
    filled = F.transform("features", lambda x, i: F.coalesce(x, F.get("_means", i)))
    return df.crossJoin(F.broadcast(means)).withColumn("features", filled).drop("_means")


def to_long(df: DataFrame, *keep: str) -> DataFrame:
    """One row per feature cell: kept columns, ``feature`` (0-based int) and ``x``.

    The outer form keeps the optimizer from inferring a size filter over the array;
    pushed below a projection of many renamed columns such a filter multiplies the
    inferred constraints.
    """
    cells = df.select(*keep, F.posexplode_outer("features").alias("feature", "x"))
    return cells.where(F.col("feature").isNotNull())


def name_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn the integer ``feature`` of a result table into the feature's name."""
    return df.withColumn("feature", F.get(F.lit(list(names)), F.col("feature")))


def cast_float32(df: DataFrame) -> DataFrame:
    """Single-precision features, for data at rest."""
    return df.withColumn("features", F.col("features").cast("array<float>"))


def moments(long: DataFrame, *by: str) -> DataFrame:
    """n, mean, population variance, min and max per feature, combined map-side."""
    return long.groupBy(*by, "feature").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.var_pop("x").alias("variance"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )


@dataclass(frozen=True)
class Scaler:
    """Column means and population standard deviations of a training table."""

    means: list[float]
    stds: list[float]
    variances: list[float]

    def apply(self, df: DataFrame) -> DataFrame:
        means, stds = F.lit(self.means), F.lit(self.stds)
        return df.withColumn(
            "features", F.transform("features", lambda x, i: (x - F.get(means, i)) / F.get(stds, i))
        )

    def passing(self, threshold: float, scaled: bool) -> list[int]:
        """Features whose variance exceeds the threshold, before or after scaling.

        A scaled column has variance 1, a constant one 0, so no second pass is needed.
        """
        values = [float(v > 0.0) for v in self.variances] if scaled else self.variances
        return [i for i, v in enumerate(values) if v > threshold]

    def subset(self, indices: Sequence[int]) -> "Scaler":
        return Scaler(*[[column[i] for i in indices] for column in (self.means, self.stds, self.variances)])


def fit_scaler(train: DataFrame) -> Scaler:
    """A constant column gets divisor 1, so it becomes 0 on the training rows."""
    rows = small_rows(moments(to_long(train)), MAX_FEATURES, "features")
    rows.sort(key=lambda r: r["feature"])
    variances = [r["variance"] for r in rows]
    return Scaler([r["mean"] for r in rows], [v**0.5 if v > 0.0 else 1.0 for v in variances], variances)


def center(df: DataFrame, means: Sequence[float]) -> DataFrame:
    middle = F.lit(list(means))
    return df.withColumn("features", F.transform("features", lambda x, i: x - F.get(middle, i)))


def feature_variances(df: DataFrame) -> DataFrame:
    """(feature, variance), population variance."""
    return moments(to_long(df)).select("feature", "variance")


def passing_features(train: DataFrame, threshold: float) -> list[int]:
    """Positions of the features whose population variance exceeds the threshold."""
    rows = small_rows(feature_variances(train).where(F.col("variance") > threshold), MAX_FEATURES, "features")
    return sorted(r["feature"] for r in rows)


def keep_features(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    return df.withColumn("features", pick(F.col("features"), list(indices)))


def class_weight(df: DataFrame, label: str = "label") -> Column:
    """Balanced weight n / (classes * n_class) as an expression over the label."""
    counts = small_rows(df.groupBy(label).count(), 10_000, "classes")
    if not counts:
        return F.lit(None).cast("double")
    total = sum(r["count"] for r in counts)
    entries = [F.lit(v) for r in counts for v in (r[label], total / (len(counts) * r["count"]))]
    return F.try_element_at(F.create_map(*entries), F.col(label))

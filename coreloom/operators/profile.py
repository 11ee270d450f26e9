"""Counts, shares, sizes and display statistics of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coreloom.operators.bounded import pin_small, small_rows
from coreloom.operators.features import MAX_FEATURES, moments, to_long
from coreloom.operators.ranks import exact_quantiles
from coreloom.session import materialize

#: Features in a block of the correlation matrix, and bytes of sums that a task holds for it.
BLOCK = 32
BAND_BYTES = 512 * 1024 * 1024


def class_counts(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def class_proportions(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by, label, n, proportion) with proportions summing to 1 per group."""
    counts = class_counts(df, label, by)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, label, "n", share.alias("proportion"))


def tagged(tables: Mapping[str, DataFrame], columns: Sequence[str], tag: str = "dataset") -> DataFrame:
    """Stack the same columns of several tables, with the table's name."""
    stacked = None
    for name, table in tables.items():
        part = table.select(F.lit(name).alias(tag), *columns)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def scalar_stats(df: DataFrame, value: str = "entropy") -> DataFrame:
    """Mean, median, min, max, population deviation."""
    median = exact_quantiles(df, value, [0.5]).first()["quantiles"][0]
    return df.agg(
        F.avg(value).alias("mean"),
        F.lit(median).alias("median"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.stddev_pop(value).alias("std"),
    )


def quantile_table(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """(q, value) rows."""
    found = exact_quantiles(df, value, qs)
    return found.select(
        F.inline(F.arrays_zip(F.lit(list(qs)).alias("q"), F.col("quantiles").alias("value")))
    ).toDF("q", "value")


def band_counts(df: DataFrame, value: str = "entropy", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows at or beyond the two percentile thresholds."""
    low_value, high_value = exact_quantiles(df, value, [low, high]).first()["quantiles"]
    return df.agg(
        F.count_if(F.col(value) >= high_value).alias("high_rows"),
        F.count_if(F.col(value) <= low_value).alias("low_rows"),
    )


def histogram(df: DataFrame, value: str, bins: int, above: float | None = None) -> DataFrame:
    """Non-empty equal-width bins (bin, n) over the value's own range."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    if above is not None:
        rows = rows.where(F.col("_v") > above)
    span = rows.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    low, high = span["low"], span["high"]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint")
    width = (high - low) / bins if high > low else 1.0
    place = F.least(F.floor((F.col("_v") - low) / width), F.lit(bins - 1)).cast("int")
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def column_histograms(df: DataFrame, bins: int = 30) -> DataFrame:
    """The same for every feature at once: (feature, bin, n)."""
    long = to_long(df).where("x is not null")
    edges = pin_small(long.groupBy("feature").agg(F.min("x").alias("low"), F.max("x").alias("high")))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(F.lit(1.0))
    place = F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1)).cast("int")
    return long.join(edges, "feature").groupBy("feature", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def minute_histogram(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.groupBy(F.minute(time).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


def _co_moments(df: DataFrame, means: list[float], first: int, last: int) -> DataFrame:
    """(a, block, c0, c1, ...): sums of products of the deviations of features ``first`` <= a < ``last`` with those of each
    block of BLOCK features at or behind a's own, added up within a task, so a task returns its part of the matrix once."""
    width = len(means)
    padded = -(-width // BLOCK) * BLOCK
    cells = [f"c{i}" for i in range(BLOCK)]

    def partial(batches):
        shift = np.array(means)
        gram = np.zeros((last - first, padded - first))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width) - shift
            gram[:, : width - first] += x[:, first:last].T @ x[:, first:]
        for top in range(first, last, BLOCK):
            a = np.arange(top, min(top + BLOCK, last), dtype="int32")
            for left in range(top, padded, BLOCK):
                part = gram[a - first, left - first : left - first + BLOCK]
                columns = [pa.array(a), pa.array(np.full(len(a), left // BLOCK, dtype="int32"))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(c) for c in part.T.copy()], ["a", "block", *cells])

    schema = "a int, block int, " + ", ".join(f"{c} double" for c in cells)
    return df.select("features").mapInArrow(partial, schema)


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlations (a, b, r) of ``features``, every pair in both orders.

    Co-moments about the means are added up per pair of feature blocks; neither the driver nor one task gets the whole
    matrix of a wide table. A task holds at most BAND_BYTES of sums: wider tables are read once for each band
    of features. ``r`` is null for a constant feature, one with a null cell, and an empty table.
    """
    means = [0.0] * len(names)
    for r in small_rows(moments(to_long(df)).select("feature", "mean"), MAX_FEATURES, "features"):
        means[r["feature"]] = r["mean"] if r["mean"] is not None else 0.0
    band = max(1, BAND_BYTES // (8 * BLOCK * max(1, len(names)))) * BLOCK
    bands = [_co_moments(df, means, at, min(at + band, len(names))) for at in range(0, len(names), band)]
    if not bands:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    cells = [f"c{i}" for i in range(BLOCK)]
    summed = reduce(DataFrame.unionAll, bands).groupBy("a", "block").agg(*[F.sum(c).alias(c) for c in cells])
    pairs = summed.select("a", "block", F.posexplode(F.array(*cells)).alias("place", "moment")).select(
        "a", (F.col("block") * BLOCK + F.col("place")).alias("b"), "moment"
    )
    pairs = materialize(pairs.where(F.col("b") < len(names)), "co-moments")
    spread = pin_small(pairs.where("a = b").select("a", F.sqrt("moment").alias("s")))
    scale = F.nullif(F.col("s_a") * F.col("s_b"), F.lit(0.0))
    r = F.nanvl(F.col("moment") / scale, F.lit(None).cast("double"))
    scored = (
        pairs.join(spread.select("a", F.col("s").alias("s_a")), "a")
        .join(spread.select(F.col("a").alias("b"), F.col("s").alias("s_b")), "b")
        .select("a", "b", r.alias("r"))
    )
    # Within a block both orders are there already.
    apart = F.floor(F.col("a") / BLOCK) != F.floor(F.col("b") / BLOCK)
    both = scored.unionAll(scored.where(apart).select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    listed = F.lit(list(names))
    return both.select(F.get(listed, F.col("a")).alias("a"), F.get(listed, F.col("b")).alias("b"), "r")


def boxplot_stats(df: DataFrame) -> DataFrame:
    """Per feature: quartiles, whiskers (extremes within 1.5 IQR) and outlier count."""
    long = to_long(df).where("x is not null")
    quartiles = pin_small(
        exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["feature"]).select(
            "feature",
            F.get("quantiles", F.lit(0)).alias("q1"),
            F.get("quantiles", F.lit(1)).alias("median"),
            F.get("quantiles", F.lit(2)).alias("q3"),
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    return (
        long.join(quartiles, "feature")
        .groupBy("feature")
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def dataset_size(tables: Mapping[str, DataFrame], bytes_per_value: int = 8) -> DataFrame:
    """(dataset, rows, features, kilobytes): logical size of the feature matrix."""
    stacked = tagged({n: t.select(F.size("features").alias("width")) for n, t in tables.items()}, ["width"])
    sizes = stacked.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.max("width").alias("features"))
    return sizes.withColumn("kilobytes", F.col("rows") * F.col("features") * bytes_per_value / 1024.0)


def reduction(full_rows: int, kept_rows: int) -> float:
    return full_rows / kept_rows if kept_rows else float("inf")


def core_set_report(full: DataFrame, core: DataFrame, label: str = "label") -> DataFrame:
    """Per class: rows and share in both tables, plus size and reduction of the core."""
    stacked = tagged({"full": full, "core": core}, [label, F.size("features").alias("width")])
    counts = stacked.groupBy(F.col(label).alias("label")).agg(
        F.count_if(F.col("dataset") == "full").alias("full_rows"),
        F.count_if(F.col("dataset") == "core").alias("core_rows"),
        F.max("width").alias("width"),
    )
    totals = counts.agg(F.sum("full_rows").alias("n_full"), F.sum("core_rows").alias("n_core")).first()
    n_full, n_core = totals["n_full"], totals["n_core"]
    return counts.select(
        "label",
        "full_rows",
        (F.col("full_rows") / n_full).alias("full_share"),
        "core_rows",
        (F.col("core_rows") / n_core).alias("core_share"),
        (F.lit(n_core) * F.col("width") * 8 / 1024.0).alias("core_kilobytes"),
        F.lit(reduction(n_full, n_core)).alias("reduction"),
    )


def label_integrity(df: DataFrame, domain: DataFrame, label: str = "label") -> DataFrame:
    """Labels that disagree with the domain: (label, problem missing/unexpected)."""
    present = df.select(F.col(label).cast("int").alias("label")).where("label is not null").distinct()
    known = domain.select("label")
    missing = known.join(present, "label", "left_anti").withColumn("problem", F.lit("missing"))
    unexpected = present.join(known, "label", "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def random_features(names: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """n distinct features in a seeded order."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("feature")))
    return names.select("feature").distinct().orderBy(order, "feature").limit(n)


def head_sample(df: DataFrame, n: int = 1000, key: str = "row_id") -> DataFrame:
    """The first n rows by key (a top-k, not a sort)."""
    return df.orderBy(key).limit(n)

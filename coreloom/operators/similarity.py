"""Does the small table still look like the big one? Two-sample statistics.

Both tables are stacked in long form with a 0/1 weight per side, so each statistic
for all features is one grouped plan, whatever the number of features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.functions.special import chi2_p_value, ks_p_value, t_p_value
from coreloom.operators.bounded import pin_small
from coreloom.operators.features import moments, to_long
from coreloom.operators.ranks import running_totals

BINS = 50
EPSILON = 1e-8
#: Kernel density: width of a box in bandwidths, terms of its expansion, and the bandwidths beyond which exp() is zero.
BOX = 0.25
TERMS = 24
REACH = 39.0


def stack(full: DataFrame, other: DataFrame, features: Sequence[int] | None = None) -> DataFrame:
    """(feature, x, full 0/1, other 0/1) of two tables with ``features`` arrays."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def side(df, is_full):
        long = to_long(df)
        if features is not None:
            long = long.where(F.col("feature").isin([int(f) for f in features]))
        return long.select("feature", "x", (one if is_full else zero).alias("full"), (zero if is_full else one).alias("other"))

    return side(full, True).unionAll(side(other, False))


def pad_missing_with_zeros(stacked: DataFrame) -> DataFrame:
    """Features absent on the other side count as a column of zeros of the full length.

    Weights make that one extra row per feature.
    """
    sizes = stacked.groupBy("feature").agg(F.sum("full").alias("n"), F.sum("other").alias("m"))
    zeros = sizes.where("m = 0").select(
        "feature", F.lit(0.0).alias("x"), F.lit(0).cast("bigint").alias("full"), F.col("n").alias("other")
    )
    return stacked.unionAll(zeros)


def distribution_distances(stacked: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov D and 1-Wasserstein distance per feature, from one ECDF pass."""
    steps = running_totals(stacked, ["feature"], "x", {"full": F.col("full"), "other": F.col("other")})
    gap = F.abs(
        F.col("cum_full") / F.nullif(F.col("tot_full"), F.lit(0)) - F.col("cum_other") / F.nullif(F.col("tot_other"), F.lit(0))
    )
    width = F.coalesce(F.col("next_value") - F.col("x"), F.lit(0.0))
    return steps.groupBy("feature").agg(
        F.max("tot_full").alias("n_full"),
        F.max("tot_other").alias("n_other"),
        F.max(gap).alias("ks_stat"),
        F.sum(gap * width).alias("wasserstein"),
    )


def ks_two_sample(stacked: DataFrame) -> DataFrame:
    """(feature, n_full, n_other, ks_stat, ks_p): exact p-value up to 10,000 rows, else that of the finite-sample law."""
    d = distribution_distances(stacked).drop("wasserstein")
    return d.withColumn(
        "ks_p", ks_p_value("ks_stat", F.col("n_full").cast("double"), F.col("n_other").cast("double"))
    )


def wasserstein(stacked: DataFrame) -> DataFrame:
    return distribution_distances(stacked).select("feature", "wasserstein")


def similar_share(tests: DataFrame, alpha: float = 0.05, p: str = "ks_p") -> DataFrame:
    """How many features have a p-value above alpha."""
    similar = F.count_if(F.col(p) > alpha)
    return tests.agg(
        similar.alias("similar"),
        F.count(F.lit(1)).alias("features"),
        (similar * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("percentage"),
    )


def welch_t_test(stacked: DataFrame) -> DataFrame:
    """Welch's unequal-variance t test per feature."""
    sides = {}
    for side in ("full", "other"):
        x = F.when(F.col(side) > 0, F.col("x"))
        sides[f"m_{side}"], sides[f"v_{side}"], sides[f"n_{side}"] = F.avg(x), F.var_samp(x), F.count(x)
    rows = stacked.groupBy("feature").agg(*[c.alias(k) for k, c in sides.items()])
    a, b = F.col("v_full") / F.col("n_full"), F.col("v_other") / F.col("n_other")
    error = F.nullif(a + b, F.lit(0.0))
    statistic = (F.col("m_full") - F.col("m_other")) / F.sqrt(error)
    freedom = (a + b) * (a + b) / F.nullif(
        a * a / F.nullif(F.col("n_full") - 1, F.lit(0)) + b * b / F.nullif(F.col("n_other") - 1, F.lit(0)), F.lit(0.0)
    )
    return rows.select("feature", statistic.alias("t_stat"), freedom.alias("t_df")).withColumn(
        "t_p", t_p_value("t_stat", "t_df")
    )


def statistical_similarity(stacked: DataFrame) -> DataFrame:
    """KS and Welch p-values side by side."""
    ks = ks_two_sample(stacked).select("feature", "ks_stat", "ks_p")
    return ks.join(welch_t_test(stacked), "feature")


def class_contingency(full: DataFrame, other: DataFrame, label: str = "label") -> DataFrame:
    """(label, full_count, other_count); a class missing on one side counts 0."""
    left = full.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("full_count"))
    right = other.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("other_count"))
    return left.join(right, "label", "full_outer").select(
        "label",
        F.coalesce("full_count", F.lit(0).cast("bigint")).alias("full_count"),
        F.coalesce("other_count", F.lit(0).cast("bigint")).alias("other_count"),
    )


def chi_square_classes(contingency: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: chi-square statistic, degrees of freedom, p-value and verdict.

    Yates' correction applies exactly when there is one degree of freedom.
    """
    table = pin_small(contingency)
    sums = table.agg(
        F.collect_list(F.struct("full_count", "other_count")).alias("cells"),
        F.sum("full_count").alias("a"),
        F.sum("other_count").alias("b"),
        F.count(F.lit(1)).alias("k"),
    )
    dof = F.col("k") - 1
    total = (F.col("a") + F.col("b")).cast("double")

    def part(observed, row, column):
        expected = row * column / total
        difference = F.abs(observed - expected)
        corrected = F.when(dof == 1, difference - F.least(F.lit(0.5), difference)).otherwise(difference)
        return corrected * corrected / expected

    statistic = F.aggregate(
        "cells",
        F.lit(0.0),
        lambda acc, c: acc
        + part(c["full_count"], c["full_count"] + c["other_count"], F.col("a"))
        + part(c["other_count"], c["full_count"] + c["other_count"], F.col("b")),
    )
    return (
        sums.select(statistic.alias("chi2"), dof.cast("bigint").alias("dof"))
        .withColumn("p_value", chi2_p_value("chi2", F.col("dof").cast("double")))
        .withColumn("similar", F.col("p_value") > alpha)
    )


def histograms(stacked: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts and densities on equal-width bins over the full side's range.

    Dense: every (feature, bin). The other side uses the same edges and what lies
    outside them is left out; the last bin includes its upper edge.
    """
    full_x = F.when(F.col("full") > 0, F.col("x"))
    edges = stacked.groupBy("feature").agg(F.min(full_x).alias("low"), F.max(full_x).alias("high"))
    same = F.col("low") == F.col("high")
    edges = edges.select(
        "feature",
        F.when(same, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(same, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    edges = pin_small(edges)
    width = (F.col("high") - F.col("low")) / bins
    place = F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1)).cast("int")
    counted = (
        stacked.join(edges, "feature")
        .where("x between low and high")
        .groupBy("feature", place.alias("bin"))
        .agg(F.sum("full").alias("full_count"), F.sum("other").alias("other_count"))
    )
    grid = edges.select("feature", "low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    dense = grid.join(counted, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("left_edge"),
        "width",
        F.coalesce("full_count", F.lit(0).cast("bigint")).alias("full_count"),
        F.coalesce("other_count", F.lit(0).cast("bigint")).alias("other_count"),
    )
    inside = dense.groupBy("feature").agg(F.sum("full_count").alias("nf"), F.sum("other_count").alias("no"))

    def density(count, n):
        return F.coalesce(F.col(count) / F.nullif(F.col(n) * F.col("width"), F.lit(0.0)), F.lit(0.0))

    return dense.join(inside, "feature").select(
        "feature",
        "bin",
        "left_edge",
        "full_count",
        "other_count",
        density("full_count", "nf").alias("full_density"),
        density("other_count", "no").alias("other_density"),
    )


def js_distance(stacked: DataFrame, bins: int = BINS, epsilon: float = EPSILON) -> DataFrame:
    """Jensen-Shannon distance (natural log) of the smoothed histograms."""
    rows = histograms(stacked, bins).select(
        "feature", (F.col("full_density") + epsilon).alias("p"), (F.col("other_density") + epsilon).alias("q")
    )
    sums = rows.groupBy("feature").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    middle = (p + q) / 2
    term = p * F.ln(p / middle) + q * F.ln(q / middle)
    return (
        rows.join(sums, "feature")
        .groupBy("feature")
        .agg(F.sqrt(F.greatest(F.sum(term) / 2, F.lit(0.0))).alias("js_distance"))
    )


def similarity_log(stacked: DataFrame, features: Sequence[int] | None = None) -> DataFrame:
    """KS statistic and p-value, JS distance and Wasserstein distance per feature."""
    rows = stacked if features is None else stacked.where(F.col("feature").isin([int(f) for f in features]))
    distances = distribution_distances(rows).withColumn(
        "ks_p", ks_p_value("ks_stat", F.col("n_full").cast("double"), F.col("n_other").cast("double"))
    )
    return distances.join(js_distance(rows), "feature").select(
        "feature", "ks_stat", "ks_p", "js_distance", "wasserstein"
    )


def _box_moments(long: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """``by``, the curve's parameters, ``centre`` and ``moments`` of every box of BOX bandwidths that holds a value.

    ``moments[n]`` is the sum of ((x - centre) / (sqrt(2) h)) ** n / n! over the box's values, combined map-side.
    """
    width = BOX * F.col("h")
    centre = F.col("start") + (F.col("_box") + 0.5) * width
    boxed = (
        long.where("x is not null")
        .join(params, by)
        .withColumn("_box", F.floor((F.col("x") - F.col("start")) / width))
        .select(*by, "_box", ((F.col("x") - centre) / (math.sqrt(2.0) * F.col("h"))).alias("_d"))
    )
    # Each power is the one before times the deviation, which generated code computes once.
    powers = [F.col("_d")]
    for _ in range(2, TERMS):
        powers.append(powers[-1] * F.col("_d"))
    terms = [F.sum(power) / float(math.factorial(n)) for n, power in enumerate(powers, 1)]
    sums = boxed.groupBy(*by, "_box").agg(F.array(F.count(F.lit(1)).cast("double"), *terms).alias("moments"))
    return sums.join(params, by).withColumn("centre", centre).drop("_box")


def kde_curves(long: DataFrame, by: Sequence[str] = ("dataset", "feature"), points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid reaching 3 bandwidths past the data.

    Scott's bandwidth. A fast Gauss transform: values add to the moments of their box, and only a box, not a value,
    meets the grid points, by the Hermite expansion of its kernels around its centre. Boxes are a quarter of a
    bandwidth wide and have 24 moments, so the cut-off adds less than 1e-33 to a value's kernel (which is at most 1),
    and less than 1e-9 of that kernel up to 27 bandwidths away. No box is left out where its kernels are above zero
    in doubles (REACH bandwidths). A curve's boxes are at most its values, and about four times its range in bandwidths.
    """
    by = list(by)
    params = long.groupBy(*by).agg(
        F.count("x").alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    params = params.where("s > 0").withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    params = pin_small(
        params.select(
            *by,
            "n",
            "h",
            (F.col("low") - 3 * F.col("h")).alias("start"),
            ((F.col("high") - F.col("low") + 6 * F.col("h")) / (points - 1)).alias("step"),
        )
    )
    at = F.col("start") + F.col("point") * F.col("step")
    first = F.ceil((F.col("centre") - REACH * F.col("h") - F.col("start")) / F.col("step"))
    last = F.floor((F.col("centre") + REACH * F.col("h") - F.col("start")) / F.col("step"))
    first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(points - 1)).cast("int")
    met = (
        _box_moments(long, params, by)
        .where(first <= last)
        .select("*", F.explode(F.sequence(first, last)).alias("point"))
        .withColumn("_u", (at - F.col("centre")) / (math.sqrt(2.0) * F.col("h")))
    )
    # Hermite polynomials by their recurrence H(n + 1) = 2 u H(n) - 2 n H(n - 1), a step per moment.
    start = F.struct(
        F.lit(0.0).alias("n"), F.lit(0.0).alias("before"), F.lit(1.0).alias("now"), F.lit(0.0).alias("total")
    )
    series = F.aggregate(
        "moments",
        start,
        lambda s, m: F.struct(
            (s["n"] + 1.0).alias("n"),
            s["now"].alias("before"),
            (2.0 * F.col("_u") * s["now"] - 2.0 * s["n"] * s["before"]).alias("now"),
            (s["total"] + m * s["now"]).alias("total"),
        ),
        lambda s: s["total"],
    )
    summed = met.groupBy(*by, "point").agg(F.sum(series * F.exp(-F.col("_u") * F.col("_u"))).alias("k"))
    grid = params.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    scale = F.col("n") * F.col("h") * F.sqrt(2 * F.pi())
    return grid.join(summed, [*by, "point"], "left").select(
        *by, "point", at.alias("x"), (F.coalesce("k", F.lit(0.0)) / scale).alias("density")
    )


def leakage(core: DataFrame, test: DataFrame) -> DataFrame:
    """One row: distinct feature rows present in both tables, and the verdict.

    128-bit digests of the rows meet first, copies combined map-side; the arrays themselves are
    compared only where a digest occurs in both tables, so no two different rows count as one.
    """
    features = F.col("features")
    digest = [F.xxhash64(features).alias("_low"), F.xxhash64(F.lit("second"), features).alias("_high")]
    sides = core.select("features", F.lit(1).alias("c"), F.lit(0).alias("t"), *digest).unionAll(
        test.select("features", F.lit(0).alias("c"), F.lit(1).alias("t"), *digest)
    )
    both = (F.col("c") == 1) & (F.col("t") == 1)
    sides_of = [F.max("c").alias("c"), F.max("t").alias("t")]
    met = pin_small(sides.groupBy("_low", "_high").agg(*sides_of).where(both).select("_low", "_high"))
    seen = sides.join(met, ["_low", "_high"], "left_semi").groupBy("features").agg(*sides_of)
    return seen.agg(F.count_if(both).alias("overlap")).withColumn("leakage", F.col("overlap") > 0)

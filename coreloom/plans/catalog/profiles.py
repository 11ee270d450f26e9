"""Counts, shares, quantiles, histograms and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from coreloom.functions.scalars import clean
from coreloom.operators import features as FE
from coreloom.operators import profile, select, similarity
from coreloom.plans import standins as S
from coreloom.plans.catalog import sql as Q
from coreloom.plans.catalog.registry import query
from coreloom.plans.catalog.tables import rounded


def entropies(spark, sf):
    """Entropy per user, rounded so that equal share multisets compare equal."""
    rows = select.with_entropy(S.probs(spark, sf))
    return rows.withColumn("entropy", clean(F.col("entropy"), 9))


@query("class_counts", f"WITH {Q.LINES} SELECT label, count(*) AS n FROM lines GROUP BY label")
def class_counts(spark, sf):
    return profile.class_counts(S.wide_num(spark, sf))


@query(
    "class_proportions",
    f"""WITH {Q.LINES}, tagged AS (
      SELECT 'full' AS dataset, label FROM lines
      UNION ALL SELECT 'core', label FROM lines WHERE md5('42:' || row_id) < '05')
    SELECT dataset, label, count(*) AS n,
           {Q.r('count(*) / CAST(sum(count(*)) OVER (PARTITION BY dataset) AS DOUBLE)')} AS proportion
    FROM tagged GROUP BY dataset, label""",
)
def class_proportions(spark, sf):
    lines = S.wide_num(spark, sf)
    both = profile.tagged({"full": lines, "core": S.core_of(lines)}, ["label"])
    return rounded(profile.class_proportions(both, by=["dataset"]), ["proportion"])


@query(
    "entropy_stats",
    f"""WITH {Q.PROBS} SELECT {Q.r('avg(entropy)')} AS mean, {Q.r('quantile_cont(entropy, 0.5)')} AS median,
    {Q.r('min(entropy)')} AS low, {Q.r('max(entropy)')} AS high, {Q.r('stddev_pop(entropy)')} AS std FROM entropies""",
)
def entropy_stats(spark, sf):
    return rounded(profile.scalar_stats(entropies(spark, sf)), ["mean", "median", "low", "high", "std"])


_QS = [0.01, 0.25, 0.5, 0.75, 0.99]


@query(
    "entropy_quantiles",
    f"WITH {Q.PROBS} " + " UNION ALL ".join(
        f"SELECT CAST({q} AS DOUBLE) AS q, {Q.r(f'quantile_cont(entropy, {q})')} AS value FROM entropies" for q in _QS
    ),
)
def entropy_quantiles(spark, sf):
    return rounded(profile.quantile_table(entropies(spark, sf), "entropy", _QS), ["value"])


@query(
    "feature_quantiles",
    f"WITH {Q.LONG} " + " UNION ALL ".join(
        f"SELECT feature, CAST({q} AS DOUBLE) AS q, {Q.r(f'quantile_cont(x, {q})', 4)} AS value FROM long GROUP BY feature"
        for q in _QS
    ),
)
def feature_quantiles(spark, sf):
    from coreloom.operators.ranks import exact_quantiles

    long = FE.to_long(S.wide_features(spark, sf))
    found = exact_quantiles(long, "x", _QS, ["feature"])
    pairs = F.arrays_zip(F.lit(_QS).alias("q"), F.col("quantiles").alias("value"))
    rows = found.select("feature", F.inline(pairs)).toDF("feature", "q", "value")
    return rounded(FE.name_features(rows, S.NUMERIC), ["value"], 4)


@query(
    "entropy_band_counts",
    f"""WITH {Q.PROBS}, t AS (SELECT quantile_cont(entropy, 0.99) AS hi, quantile_cont(entropy, 0.01) AS lo FROM entropies)
    SELECT count(*) FILTER (WHERE entropy >= hi) AS high_rows, count(*) FILTER (WHERE entropy <= lo) AS low_rows
    FROM entropies, t""",
)
def entropy_band_counts(spark, sf):
    return profile.band_counts(entropies(spark, sf))


def _histogram_sql(rows: str, value: str, bins: int) -> str:
    return f"""SELECT CAST(least(floor(({value} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM {rows}, (SELECT min({value}) AS lo, max({value}) AS hi FROM {rows}) GROUP BY 1"""


@query(
    "entropy_histogram",
    f"""WITH {Q.PROBS}, zoomed AS (SELECT * FROM entropies WHERE entropy > 0.7)
    SELECT 'all' AS part, * FROM ({_histogram_sql('entropies', 'entropy', 50)})
    UNION ALL SELECT 'zoom', * FROM ({_histogram_sql('zoomed', 'entropy', 30)})""",
)
def entropy_histogram(spark, sf):
    rows = entropies(spark, sf)
    parts = {"all": profile.histogram(rows, "entropy", 50), "zoom": profile.histogram(rows, "entropy", 30, above=0.7)}
    return profile.tagged(parts, ["bin", "n"], "part")


@query(
    "feature_variances",
    f"WITH {Q.CELLS_LONG} SELECT CAST(feature AS INTEGER) AS feature, {Q.r('var_pop(x)', 8)} AS variance FROM cells GROUP BY feature",
)
def feature_variances(spark, sf):
    return rounded(FE.feature_variances(S.features(spark, sf)), ["variance"], 8).orderBy(F.desc("variance"))


@query(
    "variance_threshold",
    f"WITH {Q.LONG} SELECT feature, {Q.r('var_pop(x)', 3)} AS variance FROM long GROUP BY feature HAVING var_pop(x) > 0.1",
)
def variance_threshold(spark, sf):
    variances = FE.feature_variances(S.wide_features(spark, sf)).where("variance > 0.1")
    return rounded(FE.name_features(variances, S.NUMERIC), ["variance"], 3)


@query(
    "variance_filter_apply",
    f"WITH {Q.LINES} SELECT row_id, l_quantity AS f0, l_extendedprice AS f1 FROM lines",
)
def variance_filter_apply(spark, sf):
    lines = S.wide_features(spark, sf)
    kept = FE.keep_features(lines, FE.passing_features(lines, 0.1))
    return kept.select("row_id", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(2)])


@query(
    "standard_scale",
    f"""WITH {Q.LINES} SELECT row_id, {', '.join(
        f"{Q.r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', 5)} AS {c}" for c in Q.NUMERIC)} FROM lines""",
)
def standard_scale(spark, sf):
    lines = S.wide_features(spark, sf)
    scaled = FE.fit_scaler(lines).apply(lines)
    return scaled.select("row_id", *[clean(F.get("features", F.lit(i)), 5).alias(c) for i, c in enumerate(S.NUMERIC)])


@query(
    "minute_histogram",
    "SELECT CAST(minute(ts) AS INTEGER) AS minute, count(*) AS n FROM events GROUP BY 1",
)
def minute_histogram(spark, sf):
    return profile.minute_histogram(S.table(spark, sf, "events"))


@query(
    "distribution_histogram",
    f"""WITH {Q.LONG}, e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY feature)
    SELECT feature, CAST(least(floor((x - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
    FROM long JOIN e USING (feature) GROUP BY 1, 2""",
)
def distribution_histogram(spark, sf):
    return FE.name_features(profile.column_histograms(S.wide_features(spark, sf), 30), S.NUMERIC)


@query(
    "correlation_matrix",
    f"WITH {Q.LINES} " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {Q.r(f'corr({a}, {b})')} AS r FROM lines" for a in Q.NUMERIC for b in Q.NUMERIC
    ),
)
def correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(S.wide_features(spark, sf), S.NUMERIC), ["r"])


@query(
    "boxplot_stats",
    f"""WITH {Q.LONG}, q AS (
      SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
      FROM long GROUP BY feature)
    SELECT feature, {Q.r('max(q1)', 4)} AS q1, {Q.r('max(median)', 4)} AS median, {Q.r('max(q3)', 4)} AS q3,
      {Q.r('min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 4)} AS whisker_low,
      {Q.r('max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 4)} AS whisker_high,
      count(*) FILTER (WHERE NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM long JOIN q USING (feature) GROUP BY feature""",
)
def boxplot_stats(spark, sf):
    rows = profile.boxplot_stats(S.wide_features(spark, sf))
    return rounded(FE.name_features(rows, S.NUMERIC), ["q1", "median", "q3", "whisker_low", "whisker_high"], 4)


_INSIDE = "z BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"


@query(
    "scaled_boxplot_stats",
    f"""WITH {Q.LONG}, scaled AS (
      SELECT feature, (x - avg(x) OVER f) / stddev_pop(x) OVER f AS z FROM long WINDOW f AS (PARTITION BY feature)),
    q AS (SELECT feature, quantile_cont(z, 0.25) AS q1, quantile_cont(z, 0.5) AS median, quantile_cont(z, 0.75) AS q3
      FROM scaled GROUP BY feature)
    SELECT feature, {Q.r('max(q1)')} AS q1, {Q.r('max(median)')} AS median, {Q.r('max(q3)')} AS q3,
      {Q.r(f'min(z) FILTER (WHERE {_INSIDE})')} AS whisker_low, {Q.r(f'max(z) FILTER (WHERE {_INSIDE})')} AS whisker_high,
      count(*) FILTER (WHERE NOT {_INSIDE}) AS outliers
    FROM scaled JOIN q USING (feature) GROUP BY feature""",
)
def scaled_boxplot_stats(spark, sf):
    """The distributions side by side on one scale: every feature with mean 0 and deviation 1."""
    lines = S.wide_features(spark, sf)
    rows = profile.boxplot_stats(FE.fit_scaler(lines).apply(lines))
    return rounded(FE.name_features(rows, S.NUMERIC), ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query(
    "dataset_size",
    f"""WITH {Q.LINES}, tagged AS (SELECT 'full' AS dataset FROM lines
      UNION ALL SELECT 'core' FROM lines WHERE md5('42:' || row_id) < '05')
    SELECT dataset, count(*) AS "rows", CAST(4 AS INTEGER) AS features, {Q.r('count(*) * 4 * 8 / 1024.0')} AS kilobytes
    FROM tagged GROUP BY dataset""",
)
def dataset_size(spark, sf):
    full = S.wide_features(spark, sf)
    return rounded(profile.dataset_size({"full": full, "core": S.core_of(full)}), ["kilobytes"])


@query(
    "compression_ratio",
    f"""WITH {Q.LINES}, c AS (SELECT count(*) AS full_rows,
      count(*) FILTER (WHERE md5('42:' || row_id) < '05') AS core_rows FROM lines)
    SELECT full_rows, core_rows, round(full_rows / CAST(core_rows AS DOUBLE), 2) AS ratio FROM c""",
)
def compression_ratio(spark, sf):
    from coreloom.functions.scalars import hash_order

    in_core = hash_order(F.col("row_id")) < F.lit("05")
    counts = S.wide_num(spark, sf).agg(F.count(F.lit(1)).alias("full_rows"), F.count_if(in_core).alias("core_rows"))
    return counts.withColumn("ratio", F.round(F.col("full_rows") / F.nullif(F.col("core_rows"), F.lit(0)), 2))


@query(
    "core_set_report",
    f"""WITH {Q.LINES}, c AS (SELECT label, count(*) AS full_rows,
      count(*) FILTER (WHERE md5('42:' || row_id) < '05') AS core_rows FROM lines GROUP BY label),
    t AS (SELECT CAST(sum(full_rows) AS DOUBLE) AS nf, CAST(sum(core_rows) AS DOUBLE) AS nc FROM c)
    SELECT label, full_rows, {Q.r('full_rows / nf')} AS full_share, core_rows, {Q.r('core_rows / nc')} AS core_share,
           {Q.r('nc * 4 * 8 / 1024.0')} AS core_kilobytes, {Q.r('nf / nc')} AS reduction FROM c, t""",
)
def core_set_report(spark, sf):
    full = S.wide_features(spark, sf)
    report = profile.core_set_report(full, S.core_of(full))
    return rounded(report, ["full_share", "core_share", "core_kilobytes", "reduction"])


@query(
    "random_features",
    f"""SELECT feature FROM (SELECT unnest([{', '.join(f"'{n}'" for n in S.EMBEDDING_NAMES)}]) AS feature)
    ORDER BY md5('42:' || feature), feature LIMIT 5""",
)
def random_features(spark, sf):
    """The table's width is one aggregate; no cell is exploded."""
    width = S.features(spark, sf).agg(F.max(F.size("features")).alias("w"))
    cells = width.select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("feature"))
    return profile.random_features(FE.name_features(cells, S.EMBEDDING_NAMES))


@query("head_sample", f"WITH {Q.LINES} SELECT row_id, l_quantity, l_extendedprice FROM lines ORDER BY row_id LIMIT 1000")
def head_sample(spark, sf):
    return profile.head_sample(S.wide_num(spark, sf).select("row_id", "l_quantity", "l_extendedprice"))


@query(
    "kde_curve",
    f"""WITH {Q.LONG}, tagged AS (SELECT 'full' AS dataset, feature, x FROM long
      UNION ALL SELECT 'core', feature, x FROM core_long),
    p AS (SELECT dataset, feature, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi
          FROM tagged GROUP BY dataset, feature),
    g AS (SELECT *, lo - 3 * h AS start, (hi - lo + 6 * h) / 199 AS step, CAST(i AS INTEGER) AS point
          FROM p, generate_series(0, 199) AS s(i)),
    m AS (SELECT dataset, feature, x, count(*) AS c FROM tagged GROUP BY dataset, feature, x)
    SELECT dataset, feature, point, {Q.r('max(start + point * step)', 4)} AS x,
           {Q.r('sum(c * exp(-0.5 * pow((start + point * step - m.x) / h, 2))) / (max(n * h) * sqrt(2 * pi()))', 8)} AS density
    FROM g JOIN m USING (dataset, feature) GROUP BY dataset, feature, point""",
)
def kde_curve(spark, sf):
    full = S.wide_features(spark, sf)
    long = profile.tagged({"full": full, "core": S.core_of(full)}, ["features"])
    curves = similarity.kde_curves(FE.to_long(long, "dataset"))
    named = FE.name_features(curves, S.NUMERIC)
    return rounded(rounded(named, ["x"], 4), ["density"], 8)

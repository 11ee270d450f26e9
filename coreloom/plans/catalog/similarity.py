"""Two-sample statistics of the line items against their hash-chosen core."""

from __future__ import annotations

from pyspark.sql import functions as F

from coreloom.functions.scalars import hash_order
from coreloom.operators import features as FE
from coreloom.operators import similarity as SI
from coreloom.plans import standins as S
from coreloom.plans.catalog import sql as Q
from coreloom.plans.catalog.registry import query
from coreloom.plans.catalog.tables import rounded


def stacked(spark, sf):
    full = S.wide_features(spark, sf)
    return SI.stack(full, S.core_of(full))


def named(df):
    return FE.name_features(df, S.NUMERIC)


def ecdf_sql(rows: str) -> str:
    """Empirical distribution functions of both sides on distinct values."""
    return f"""
d AS (SELECT feature, x, sum(is_full) AS f, sum(is_other) AS o FROM {rows} GROUP BY feature, x),
e AS (SELECT feature, x, CAST(sum(sum(f)) OVER w AS DOUBLE) AS cf, CAST(sum(sum(o)) OVER w AS DOUBLE) AS co,
             sum(sum(f)) OVER (PARTITION BY feature) AS nf, sum(sum(o)) OVER (PARTITION BY feature) AS no,
             lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx
      FROM d GROUP BY feature, x WINDOW w AS (PARTITION BY feature ORDER BY x)),
dist AS (SELECT feature, CAST(max(nf) AS BIGINT) AS n_full, CAST(max(no) AS BIGINT) AS n_other,
                max(abs(cf / nf - co / no)) AS d, sum(abs(cf / nf - co / no) * coalesce(nx - x, 0)) AS w
         FROM e GROUP BY feature)"""


ECDF = f"{Q.STACKED},{ecdf_sql('stacked')}"

# For samples of over 10,000 rows whose n m / (n + m) is at least 140; the smallest tables have exact values instead.
_ROWS = "round(n_full * CAST(n_other AS DOUBLE) / (n_full + n_other))"
_Z = f"(d * sqrt({_ROWS}))"
_A, _B = "(pi() * pi() * (k + 0.5) * (k + 0.5))", "(pi() * pi() * k * k)"
_EA, _EB = f"exp(-{_A} / (2 * z * z))", f"exp(-{_B} / (2 * z * z))"
KS_P = f"""CASE WHEN {_ROWS} * d <= 0.5 THEN 1.0 WHEN d >= 1 OR {_ROWS} * d * d >= 18 THEN 0.0 ELSE (
  SELECT least(1.0, greatest(0.0, 1 - sqrt(pi() / 2) * (
    sum({_EA}) / z
    + sum(({_A} - z * z) * {_EA}) / (6 * pow(z, 4) * sqrt(r))
    + (sum((6 * pow(z, 6) + 2 * pow(z, 4) + {_A} * (2 * pow(z, 4) - 5 * z * z) + {_A} * {_A} * (1 - 2 * z * z)) * {_EA}) / (72 * pow(z, 7))
       - sum({_B} * {_EB}) / (36 * pow(z, 3))) / r
    + (sum((pow({_A}, 3) * (5 - 30 * z * z) + {_A} * {_A} * (212 * pow(z, 4) - 60 * z * z) + {_A} * (135 * pow(z, 4) - 96 * pow(z, 6))
            - 30 * pow(z, 6) - 90 * pow(z, 8)) * {_EA}) / (6480 * pow(z, 10))
       + sum((3 * {_B} * z * z - {_B} * {_B}) * {_EB}) / (216 * pow(z, 6))) / pow(r, 1.5))))
  FROM (SELECT {_Z} AS z, {_ROWS} AS r, CAST(i AS DOUBLE) AS k FROM generate_series(-60, 60) AS s(i)) GROUP BY z, r) END"""


@query("ks_two_sample", f"WITH {ECDF} SELECT feature, n_full, n_other, {Q.r('d')} AS ks_stat, {Q.r(KS_P)} AS ks_p FROM dist")
def ks_two_sample(spark, sf):
    return rounded(named(SI.ks_two_sample(stacked(spark, sf))), ["ks_stat", "ks_p"])


@query("wasserstein", f"WITH {ECDF} SELECT feature, {Q.r('w', 5)} AS wasserstein FROM dist")
def wasserstein(spark, sf):
    return rounded(named(SI.wasserstein(stacked(spark, sf))), ["wasserstein"], 5)


@query(
    "similar_feature_share",
    f"""WITH {ECDF}, p AS (SELECT {KS_P} AS p FROM dist)
    SELECT count(*) FILTER (WHERE p > 0.05) AS similar, count(*) AS features,
           {Q.r('count(*) FILTER (WHERE p > 0.05) * 100.0 / count(*)')} AS percentage FROM p""",
)
def similar_feature_share(spark, sf):
    return rounded(SI.similar_share(SI.ks_two_sample(stacked(spark, sf))), ["percentage"])


@query(
    "ks_zero_padded",
    f"""WITH {Q.STACKED}, padded AS (
      SELECT * FROM stacked WHERE is_full = 1 OR feature IN ('l_quantity', 'l_extendedprice')
      UNION ALL SELECT feature, 0.0, 0, 1 FROM long WHERE feature IN ('l_discount', 'l_tax')),
    {ecdf_sql('padded')}
    SELECT feature, n_full, n_other, {Q.r('d')} AS ks_stat, {Q.r('w', 5)} AS wasserstein FROM dist""",
)
def ks_zero_padded(spark, sf):
    full = S.wide_features(spark, sf)
    narrow = FE.keep_features(S.core_of(full), [0, 1])
    padded = SI.pad_missing_with_zeros(SI.stack(full, narrow))
    return rounded(rounded(named(SI.distribution_distances(padded)), ["ks_stat"]), ["wasserstein"], 5)


# Student's two-sided tail as an integral: with t = sqrt(f) tan(u) the density is cos(u) ** (f - 1), by Simpson's rule from the
# given angle to where the rest is below 1e-20 (or a right angle).
T_P = """(SELECT 2 * exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(pi()) * least(pi() / 2 - u, 10 / sqrt(f)) / 4000 / 3
    * sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * pow(cos(u + i * least(pi() / 2 - u, 10 / sqrt(f)) / 4000), f - 1))
    FROM (SELECT atan(abs(t) / sqrt(f)) AS u, i FROM generate_series(0, 4000) AS g(i)) GROUP BY u)"""


@query(
    "welch_t_test",
    f"""WITH {Q.STACKED}, m AS (SELECT feature,
      avg(x) FILTER (WHERE is_full = 1) AS ma, var_samp(x) FILTER (WHERE is_full = 1) AS va, sum(is_full) AS na,
      avg(x) FILTER (WHERE is_other = 1) AS mb, var_samp(x) FILTER (WHERE is_other = 1) AS vb, sum(is_other) AS nb
      FROM stacked GROUP BY feature),
    s AS (SELECT *, va / na AS a, vb / nb AS b FROM m)
    SELECT feature, {Q.r('(ma - mb) / sqrt(a + b)', 5)} AS t_stat,
           {Q.r('(a + b) * (a + b) / (a * a / (na - 1) + b * b / (nb - 1))', 4)} AS t_df, {Q.r(T_P)} AS t_p
    FROM (SELECT *, (ma - mb) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (na - 1) + b * b / (nb - 1)) AS f FROM s)""",
)
def welch_t_test(spark, sf):
    tests = named(SI.welch_t_test(stacked(spark, sf)))
    return rounded(rounded(rounded(tests, ["t_stat"], 5), ["t_df"], 4), ["t_p"])


@query("statistical_similarity")
def statistical_similarity(spark, sf):
    return named(SI.statistical_similarity(stacked(spark, sf)))


CONTINGENCY = f"""{Q.LINES}, table_ AS (
  SELECT label, count(*) AS full_count, count(*) FILTER (WHERE md5('42:' || row_id) < '05') AS other_count
  FROM lines GROUP BY label)"""


@query("class_contingency", f"WITH {CONTINGENCY} SELECT label, full_count, other_count FROM table_")
def class_contingency(spark, sf):
    lines = S.wide_num(spark, sf)
    return SI.class_contingency(lines, S.core_of(lines))


@query(
    "chi_square_classes",
    f"""WITH {CONTINGENCY}, t AS (SELECT *, CAST(sum(full_count) OVER () AS DOUBLE) AS a,
      CAST(sum(other_count) OVER () AS DOUBLE) AS b, full_count + other_count AS r FROM table_),
    x AS (SELECT *, r * a / (a + b) AS ea, r * b / (a + b) AS eb FROM t),
    c AS (SELECT sum(pow(full_count - ea, 2) / ea + pow(other_count - eb, 2) / eb) AS chi2, count(*) - 1 AS dof FROM x)
    -- three classes: two degrees of freedom, whose tail is exp(-x / 2)
    SELECT {Q.r('chi2')} AS chi2, dof, {Q.r('exp(-chi2 / 2)')} AS p_value, exp(-chi2 / 2) > 0.05 AS similar FROM c""",
)
def chi_square_classes(spark, sf):
    lines = S.wide_num(spark, sf)
    test = SI.chi_square_classes(SI.class_contingency(lines, S.core_of(lines)))
    return rounded(test, ["chi2", "p_value"])


HISTOGRAMS = f"""{Q.STACKED},
edges AS (SELECT feature, min(x) AS lo, (max(x) - min(x)) / 50 AS width, max(x) AS hi FROM long GROUP BY feature),
counted AS (SELECT feature, CAST(least(floor((x - lo) / width), 49) AS INTEGER) AS bin,
                   sum(is_full) AS f, sum(is_other) AS o
            FROM stacked JOIN edges USING (feature) WHERE x BETWEEN lo AND hi GROUP BY 1, 2),
dense AS (SELECT e.feature, CAST(i AS INTEGER) AS bin, e.lo + i * e.width AS left_edge, e.width,
                 CAST(coalesce(f, 0) AS BIGINT) AS f, CAST(coalesce(o, 0) AS BIGINT) AS o
          FROM edges e CROSS JOIN generate_series(0, 49) AS g(i)
          LEFT JOIN counted c ON c.feature = e.feature AND c.bin = i),
hist AS (SELECT *, f / (sum(f) OVER (PARTITION BY feature) * width) AS fd,
                   o / (sum(o) OVER (PARTITION BY feature) * width) AS od FROM dense)"""


@query(
    "feature_histograms",
    f"""WITH {HISTOGRAMS} SELECT feature, bin, {Q.r('left_edge', 4)} AS left_edge, f AS full_count, o AS other_count,
    {Q.r('fd')} AS full_density, {Q.r('od')} AS other_density FROM hist""",
)
def feature_histograms(spark, sf):
    rows = named(SI.histograms(stacked(spark, sf)))
    return rounded(rounded(rows, ["left_edge"], 4), ["full_density", "other_density"])


@query(
    "js_distance",
    f"""WITH {HISTOGRAMS}, s AS (SELECT feature, (fd + 1e-8) / sum(fd + 1e-8) OVER (PARTITION BY feature) AS p,
      (od + 1e-8) / sum(od + 1e-8) OVER (PARTITION BY feature) AS q FROM hist)
    SELECT feature, {Q.r('sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0))')} AS js_distance
    FROM s GROUP BY feature""",
)
def js_distance(spark, sf):
    return rounded(named(SI.js_distance(stacked(spark, sf))), ["js_distance"])


@query(
    "feature_similarity_log",
    f"""WITH {HISTOGRAMS},{ecdf_sql('stacked')},
    s AS (SELECT feature, (fd + 1e-8) / sum(fd + 1e-8) OVER (PARTITION BY feature) AS p,
      (od + 1e-8) / sum(od + 1e-8) OVER (PARTITION BY feature) AS q FROM hist),
    j AS (SELECT feature, sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)) AS js
          FROM s GROUP BY feature)
    SELECT feature, {Q.r('d')} AS ks_stat, {Q.r(KS_P)} AS ks_p, {Q.r('js')} AS js_distance, {Q.r('w', 5)} AS wasserstein
    FROM dist JOIN j USING (feature)""",
)
def feature_similarity_log(spark, sf):
    log = named(SI.similarity_log(stacked(spark, sf), range(len(S.NUMERIC))))
    return rounded(rounded(log, ["ks_stat", "ks_p", "js_distance"]), ["wasserstein"], 5)


_CELLS_OF_A_ROW = "l_quantity, l_extendedprice, l_discount, l_tax"


@query(
    "leakage_check",
    f"""WITH {Q.LINES}, shared AS (
      SELECT {_CELLS_OF_A_ROW} FROM lines WHERE md5('42:' || row_id) < '05'
      INTERSECT SELECT {_CELLS_OF_A_ROW} FROM lines WHERE md5('42:' || row_id) >= '05')
    SELECT count(*) AS overlap, count(*) > 0 AS leakage FROM shared""",
)
def leakage_check(spark, sf):
    """Core rows against all others, over every column."""
    lines = S.wide_num(spark, sf)
    features = F.array(*[F.col(c) for c in S.NUMERIC]).alias("features")
    rest = lines.where(hash_order(F.col("row_id")) >= F.lit("05"))
    return SI.leakage(S.core_of(lines).select(features), rest.select(features))

"""Hourly event series: rolling, lag, autocorrelation, decomposition."""

from __future__ import annotations

from coreloom.operators import series as SR
from coreloom.operators.ranks import with_position
from coreloom.plans import standins as S
from coreloom.plans.catalog import sql as Q
from coreloom.plans.catalog.registry import query
from coreloom.plans.catalog.tables import rounded


def indexed(spark, sf):
    return with_position(S.hourly(spark, sf), ["series_id"], "t")


W = "PARTITION BY series_id ORDER BY idx"


@query("time_series", f"WITH {Q.HOURLY} SELECT series_id, t, {Q.r('value')} AS value FROM hourly")
def time_series(spark, sf):
    return rounded(SR.time_series(S.hourly(spark, sf)), ["value"])


@query(
    "rolling_stats",
    f"""WITH {Q.HOURLY}, w AS (SELECT series_id, idx,
      CASE WHEN idx >= 11 THEN avg(value) OVER win END AS m, CASE WHEN idx >= 11 THEN stddev_samp(value) OVER win END AS s
      FROM indexed WINDOW win AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT series_id, idx, {Q.r('m', 8)} AS rolling_mean, {Q.r('s', 8)} AS rolling_std,
           {Q.r('m - s', 8)} AS lower, {Q.r('m + s', 8)} AS upper FROM w""",
)
def rolling_stats(spark, sf):
    rows = SR.rolling_stats(indexed(spark, sf), 12).drop("t", "value")
    return rounded(rows, ["rolling_mean", "rolling_std", "lower", "upper"], 8)


@query(
    "difference",
    f"WITH {Q.HOURLY} SELECT series_id, idx, {Q.r('value')} AS value, {Q.r(f'value - lag(value) OVER ({W})')} AS difference FROM indexed",
)
def difference(spark, sf):
    return rounded(SR.difference(indexed(spark, sf)).drop("t"), ["value", "difference"])


@query(
    "lag_pairs",
    f"""WITH {Q.HOURLY}, l AS (SELECT series_id, idx, value, lag(value, 3) OVER ({W}) AS lagged FROM indexed)
    SELECT series_id, idx, {Q.r('value')} AS value, {Q.r('lagged')} AS lagged FROM l WHERE lagged IS NOT NULL""",
)
def lag_pairs(spark, sf):
    rows = SR.lagged(indexed(spark, sf), 3).where("lagged is not null").drop("t")
    return rounded(rows, ["value", "lagged"])


ACF = f"""{Q.HOURLY}, c AS (SELECT series_id, idx, value - avg(value) OVER (PARTITION BY series_id) AS d,
      count(*) OVER (PARTITION BY series_id) AS n FROM indexed),
    k AS (SELECT CAST(i AS INTEGER) AS lag FROM generate_series(0, 50) AS g(i)),
    p AS (SELECT a.series_id, k.lag, sum(a.d * b.d) AS s, max(a.n) AS n FROM c a CROSS JOIN k
          JOIN c b ON b.series_id = a.series_id AND b.idx = a.idx + k.lag GROUP BY a.series_id, k.lag),
    r AS (SELECT series_id, lag, n, s / first_value(s) OVER (PARTITION BY series_id ORDER BY lag) AS acf FROM p)"""


@query(
    "acf",
    f"""WITH {ACF},
    b AS (SELECT *, coalesce(sum(CASE WHEN lag > 0 THEN acf * acf ELSE 0 END)
        OVER (PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sq FROM r)
    SELECT series_id, lag, {Q.r('acf')} AS acf,
           {Q.r('CASE WHEN lag = 0 THEN 0.0 ELSE 1.959963984540054 * sqrt((1 + 2 * sq) / n) END')} AS band FROM b""",
)
def acf(spark, sf):
    return rounded(SR.acf(indexed(spark, sf), 50), ["acf", "band"])


@query(
    "pacf",
    f"""WITH RECURSIVE {ACF}, listed AS (SELECT series_id, list(acf ORDER BY lag) AS r FROM r GROUP BY series_id),
    steps AS (
      SELECT series_id, 0 AS lag, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS error, CAST(1 AS DOUBLE) AS pacf FROM listed
      UNION ALL
      SELECT series_id, lag + 1, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda p: p[1] - f * p[2]), f),
        error * (1 - f * f), f
      FROM (SELECT series_id, lag, phi, error,
              (r[lag + 2] - CASE WHEN lag = 0 THEN 0 ELSE list_dot_product(phi, list_reverse(r[2:lag + 1])) END) / error AS f
            FROM steps JOIN listed USING (series_id) WHERE lag + 1 < len(r)))
    SELECT series_id, CAST(lag AS INTEGER) AS lag, {Q.r('pacf')} AS pacf FROM steps""",
)
def pacf(spark, sf):
    return rounded(SR.pacf(SR.acf(indexed(spark, sf), 50)), ["pacf"])


@query(
    "seasonal_decompose",
    f"""WITH {Q.HOURLY}, t AS (SELECT series_id, idx, value, CASE WHEN count(*) OVER c = 13 THEN
      (sum(value) OVER c - 0.5 * (lag(value, 6) OVER s + lead(value, 6) OVER s)) / 12 END AS trend
      FROM indexed WINDOW c AS ({W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), s AS ({W})),
    p AS (SELECT series_id, idx % 12 AS phase, avg(value - trend) AS m FROM t GROUP BY series_id, idx % 12),
    q AS (SELECT series_id, phase, m - avg(m) OVER (PARTITION BY series_id) AS seasonal FROM p)
    SELECT t.series_id, t.idx, {Q.r('trend', 8)} AS trend, {Q.r('seasonal', 8)} AS seasonal,
           {Q.r('value - trend - seasonal', 8)} AS resid
    FROM t JOIN q ON t.series_id = q.series_id AND t.idx % 12 = q.phase""",
)
def seasonal_decompose(spark, sf):
    rows = SR.seasonal_decompose(indexed(spark, sf)).drop("t", "value", "phase")
    return rounded(rows, ["trend", "seasonal", "resid"], 8)

"""Ordered-series statistics without sorting a whole series in one task.

A series is addressed by a dense position (``ranks.with_position``). It is cut into
chunks of consecutive positions and each chunk borrows the few rows it needs from
its neighbours, so even a series with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreloom.operators.bounded import pin_small

CHUNK = 100_000


def chunked(df: DataFrame, by: Sequence[str], idx: str, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Copy rows near a chunk border into the neighbour; ``_own`` marks the originals."""
    chunk = max(chunk, before, after, 1)
    home = F.floor(F.col(idx) / chunk).cast("bigint")
    offset = F.col(idx) - home * chunk
    homes = F.array(
        home,
        F.when(offset >= chunk - before, home + 1),
        F.when((offset < after) & (home > 0), home - 1),
    )
    copies = df.select("*", F.explode(F.array_compact(homes)).alias("_chunk"))
    return copies.withColumn("_own", F.col("_chunk") == home)


def chunk_window(by: Sequence[str], idx: str):
    return Window.partitionBy(*by, "_chunk").orderBy(idx)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_chunk", "_own")


def rolling_stats(
    df: DataFrame, window: int, by: Sequence[str] = ("series_id",), idx: str = "idx", value: str = "value", chunk: int = CHUNK
) -> DataFrame:
    """Rolling mean, sample deviation and the one-deviation band; null until full."""
    by = list(by)
    rows = chunked(df, by, idx, before=window - 1, chunk=chunk)
    frame = chunk_window(by, idx).rowsBetween(-(window - 1), 0)
    full = F.count(value).over(frame) == window
    mean = F.when(full, F.avg(value).over(frame))
    std = F.when(full, F.stddev_samp(value).over(frame))
    rows = own_rows(rows.withColumn("rolling_mean", mean).withColumn("rolling_std", std))
    return rows.withColumn("lower", F.col("rolling_mean") - F.col("rolling_std")).withColumn(
        "upper", F.col("rolling_mean") + F.col("rolling_std")
    )


def lagged(
    df: DataFrame, lag: int = 1, by: Sequence[str] = ("series_id",), idx: str = "idx", value: str = "value", chunk: int = CHUNK
) -> DataFrame:
    """Add ``lagged``: the value ``lag`` positions earlier."""
    by = list(by)
    rows = chunked(df, by, idx, before=lag, chunk=chunk)
    return own_rows(rows.withColumn("lagged", F.lag(value, lag).over(chunk_window(by, idx))))


def difference(df: DataFrame, by: Sequence[str] = ("series_id",), idx: str = "idx", value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """Add ``difference``: change from the previous position."""
    return lagged(df, 1, by, idx, value, chunk).withColumn("difference", F.col(value) - F.col("lagged")).drop("lagged")


def acf(
    df: DataFrame, lags: int = 50, by: Sequence[str] = ("series_id",), idx: str = "idx", value: str = "value", chunk: int = CHUNK
) -> DataFrame:
    """Biased autocorrelation for lags 0..lags with its 95 % band.

    The band follows Bartlett's formula. All lag products come from one window per
    chunk and are summed before they shuffle. Lags beyond the series are left out.
    """
    by = list(by)
    means = pin_small(df.groupBy(*by).agg(F.avg(value).alias("_m"), F.count(value).alias("n")))
    rows = df.join(means, by).withColumn("_d", F.col(value) - F.col("_m")).select(*by, idx, "n", "_d")
    rows = chunked(rows, by, idx, before=lags, chunk=chunk)
    window = chunk_window(by, idx)
    products = [F.col("_d") * F.col("_d")] + [F.col("_d") * F.lag("_d", k).over(window) for k in range(1, lags + 1)]
    rows = own_rows(rows.select(*by, "n", "_chunk", "_own", *[p.alias(f"_p{k}") for k, p in enumerate(products)]))
    sums = rows.groupBy(*by, "n").agg(F.array(*[F.sum(f"_p{k}") for k in range(lags + 1)]).alias("_s"))
    long = sums.select(*by, "n", F.get("_s", F.lit(0)).alias("_v"), F.posexplode("_s").alias("lag", "_c"))
    long = long.where(F.col("lag") < F.col("n")).withColumn(
        "acf", F.coalesce(F.col("_c"), F.lit(0.0)) / F.nullif(F.col("_v"), F.lit(0.0))
    )
    earlier = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(
        F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf")).otherwise(0.0)).over(earlier), F.lit(0.0)
    )
    band = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(1.959963984540054 * F.sqrt((1 + 2 * squares) / F.col("n")))
    return long.select(*by, "lag", "acf", band.alias("band"))


def pacf(autocorrelations: DataFrame, by: str = "series_id") -> DataFrame:
    """Partial autocorrelation by the Yule-Walker recursion on the ACF table (lags from 0 without gaps).

    A group is one series' ACF, at most lags + 1 rows; the recursion's coefficients are the state of an array aggregate.
    """
    r = F.col("_r")
    nothing = F.array().cast("array<double>")

    def step(state: Column, k: Column) -> Column:
        known = F.zip_with(state["phi"], F.reverse(F.slice(r, F.lit(2), k - 1)), lambda p, q: p * q)
        reached = F.aggregate(known, F.lit(0.0), lambda total, v: total + v)
        found = F.when(state["error"] > 1e-12, (F.get(r, k) - reached) / state["error"]).otherwise(F.lit(float("nan")))

        def following(f: Column) -> Column:
            phi = F.zip_with(state["phi"], F.reverse(state["phi"]), lambda p, q: p - f * q)
            return F.struct(
                F.concat(phi, F.array(f)).alias("phi"),
                (state["error"] * (1 - f * f)).alias("error"),
                F.concat(state["out"], F.array(f)).alias("out"),
            )

        return F.element_at(F.transform(F.array(found), following), 1)

    listed = autocorrelations.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_l"))
    listed = listed.select(by, F.transform("_l", lambda c: c["lag"]).alias("_lags"), F.transform("_l", lambda c: c["acf"]).alias("_r"))
    start = F.struct(nothing.alias("phi"), F.lit(1.0).alias("error"), F.array(F.lit(1.0)).alias("out"))
    steps = F.slice(F.sequence(F.lit(0), F.size(r)), 2, F.size(r) - 1)  # 1 to the last lag, none for lag 0 alone
    out = F.aggregate(steps, start, step)["out"]
    return listed.select(by, F.inline(F.arrays_zip(F.col("_lags").alias("lag"), out.alias("pacf")))).toDF(by, "lag", "pacf")


def seasonal_decompose(
    df: DataFrame, period: int = 12, by: Sequence[str] = ("series_id",), idx: str = "idx", value: str = "value", chunk: int = CHUNK
) -> DataFrame:
    """Additive decomposition: centred moving-average trend, phase means, residual.

    An even period weighs both end points half. Trend and residual are null where
    the centred window is incomplete.
    """
    by = list(by)
    half = period // 2
    rows = chunked(df, by, idx, before=half, after=half, chunk=chunk)
    window = chunk_window(by, idx)
    frame = window.rowsBetween(-half, half)
    complete = F.count(value).over(frame) == 2 * half + 1
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(window) + F.lead(value, half).over(window)) / 2
    rows = own_rows(rows.withColumn("trend", F.when(complete, total / period)))
    rows = rows.withColumn("phase", (F.col(idx) % period).cast("int"))
    phases = rows.groupBy(*by, "phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_p"))
    level = phases.groupBy(*by).agg(F.avg("_p").alias("_level"))
    seasonal = phases.join(level, by).select(*by, "phase", (F.col("_p") - F.col("_level")).alias("seasonal"))
    seasonal = pin_small(seasonal)
    return rows.join(seasonal, [*by, "phase"]).withColumn(
        "resid", F.col(value) - F.col("trend") - F.col("seasonal")
    )


def time_series(df: DataFrame, by: Sequence[str] = ("series_id",), time: str = "t", value: str = "value") -> DataFrame:
    """The plotted line: series, time and value in time order."""
    return df.select(*by, time, value).orderBy(*by, time)

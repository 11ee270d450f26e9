"""Small sides of joins: bring them to the driver only behind a size check."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from coreloom.session import materialize

MAX_PINNED_ROWS = 50_000
MAX_PINNED_BYTES = 64 * 1024 * 1024
#: Keys with more than this part of the rows are hot (so there are at most as many); each is dealt to SPREAD tasks.
HOT_PART = 1_000
SPREAD = 32


def held(df: DataFrame, max_rows: int = MAX_PINNED_ROWS, max_bytes: int = MAX_PINNED_BYTES) -> tuple[DataFrame, pa.Table | None]:
    """The table, written, and its rows on the driver if they are within both bounds."""
    bytes_of = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
    counted = Observation()
    written = materialize(df.observe(counted, F.count(F.lit(1)).alias("rows"), F.sum(bytes_of).alias("size")), "pinned")
    if counted.get["rows"] > max_rows or (counted.get["size"] or 0) > max_bytes:
        return written, None
    return written, written.toArrow()


def _pinned(df: DataFrame, max_rows: int, max_bytes: int) -> tuple[DataFrame, bool]:
    written, table = held(df, max_rows, max_bytes)
    if table is None:
        return written, False
    spark = df.sparkSession
    if table.num_rows == 0:
        return F.broadcast(spark.createDataFrame([], df.schema)), True
    return F.broadcast(spark.createDataFrame(table, df.schema)), True


def pin_small(df: DataFrame, max_rows: int = MAX_PINNED_ROWS, max_bytes: int = MAX_PINNED_BYTES) -> DataFrame:
    """Evaluate a summary table once, and mark it for broadcast if it is small.

    The table is written to the shared folder and its rows and bytes are counted there; only
    a table within both bounds comes to the driver. Past either the written table comes
    back, so the join that follows is an ordinary shuffled one.
    """
    return _pinned(df, max_rows, max_bytes)[0]


def join_summary(rows: DataFrame, summary: DataFrame, on: str, key: str, sizes: DataFrame) -> DataFrame:
    """``rows`` joined with ``summary``, which has one row per value of ``on``, whatever their sizes.

    A small summary is broadcast (see :func:`pin_small`). Else both are shuffled, and the rows of hot values, at most
    HOT_PART of them by ``sizes`` (a written table of ``on`` and ``size``), are dealt out by ``key`` to SPREAD copies of their summary.
    """
    table, small = _pinned(summary, MAX_PINNED_ROWS, MAX_PINNED_BYTES)
    if small:
        return rows.join(table, on)
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = F.broadcast(sizes.where(F.col("size") * HOT_PART > total).select(on, F.lit(SPREAD).alias("_spread")))
    spread = F.coalesce("_spread", F.lit(1))
    dealt = rows.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(key), spread).cast("int")).drop("_spread")
    copies = table.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), spread - 1))).drop("_spread")
    return dealt.join(copies, [on, "_part"]).drop("_part")


def small_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that must be small by nature (classes, features, folds)."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} {what}")
    return rows


def typed_literal(value, data_type: str) -> Column:
    """A literal of the given SQL type; text keeps timestamps free of time zones."""
    if value is None or isinstance(value, (bool, int, float)):
        return F.lit(value).cast(data_type)
    return F.lit(str(value)).cast(data_type)

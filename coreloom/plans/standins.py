"""The reference-shaped inputs, derived from the given tables with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.functions.scalars import hash_order

NODES = ["node0", "node1", "node2", "node3"]
EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
FLAG_CODES = {"A": 0, "N": 1, "R": 2}
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EMBEDDING_WIDTH = 64
EMBEDDING_NAMES = [f"e{i:02d}" for i in range(EMBEDDING_WIDTH)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hour():
    return F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")


def _node():
    return F.concat(F.lit("node"), (F.col("user_id") % 4).cast("string"))


def sensor_long(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        _hour().alias("Time"), _node().alias("Node"), F.col("event_type").alias("sensor"), F.col("value").alias("reading")
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Per (Time, Node) the last event's type."""
    rows = table(spark, sf, "events").select(
        _hour().alias("Time"), _node().alias("Node"), "event_type", "ts", "event_id"
    )
    return rows.groupBy("Time", "Node").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("Value"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, features, label) from the embeddings."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def _line_id():
    return F.md5(
        F.concat_ws(
            "|",
            F.col("l_orderkey").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        )
    )


def wide_num(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, four numeric columns, label, l_shipdate) from the line items."""
    flag = F.col("l_returnflag")
    label = F.when(flag == "A", 0).when(flag == "N", 1).when(flag == "R", 2)
    return table(spark, sf, "lineitem").select(_line_id().alias("row_id"), *NUMERIC, label.alias("label"), "l_shipdate")


def wide_features(spark: SparkSession, sf: str) -> DataFrame:
    """The line items as (row_id, label, features)."""
    return wide_num(spark, sf).select("row_id", "label", F.array(*NUMERIC).alias("features"))


def core_of(df: DataFrame) -> DataFrame:
    """About 2 % of the rows, chosen by hash: leading byte of the shuffling key below 5."""
    return df.where(hash_order(F.col("row_id").cast("string")) < F.lit("05"))


def probs(spark: SparkSession, sf: str) -> DataFrame:
    """Per user the share of each event type, and the most frequent type as label."""
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("row_id")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("event_type") == name).alias(name) for name in EVENT_CODES],
    )
    best = F.greatest(*EVENT_CODES)
    label = F.lit(None).cast("int")
    for name, code in reversed(EVENT_CODES.items()):
        label = F.when(F.col(name) == best, code).otherwise(label)
    return counts.select(
        "row_id", F.array(*[F.col(name) / F.col("n") for name in EVENT_CODES]).alias("probability"), label.alias("label")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed classification rule over the line items, with a tied score."""
    return wide_num(spark, sf).select(
        "row_id", "label", (F.col("l_quantity").cast("int") % 3).alias("prediction"), F.col("l_discount").alias("score")
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, t, value): mean event value per type and hour."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), _hour().alias("t"), "value")
    return rows.groupBy("series_id", "t").agg(F.avg("value").alias("value"))

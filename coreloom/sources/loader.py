"""Sensor and response series from per-node CSV trees.

Layout: ``<responses>/<node>/responses.csv`` and ``<sensors>/<node>/<sensor>.csv``.
A file may also be a folder of part files with the same name, and a node folder may
be written ``Node=<node>`` as partitioned writers do. All files are one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_SCHEMA = "Time string, Value string"
SENSOR_SCHEMA = "Time string, reading double"
NODE_DIR = r"/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?([^/=]+)\.csv(?:/[^/]+)?$"


def parse_time(text: Column, time_format: str | None = None) -> Column:
    """Timestamp without time zone from text; malformed text fails."""
    return F.to_timestamp_ntz(text, F.lit(time_format)) if time_format else text.cast("timestamp_ntz")


def _path_part(group: int) -> Column:
    return F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), NODE_DIR, group)


def _read(spark: SparkSession, root: str, schema: str, nodes: Sequence[str] | None) -> DataFrame:
    """One scan of the wanted nodes' files; other nodes are not even listed."""
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
    )
    path = root.rstrip("/")
    if nodes is not None:
        path = f"{path}/{{{','.join(f'{n},*={n}' for n in nodes)}}}"
    rows = reader.csv(path)
    rows = rows.withColumn("Node", _path_part(1)).withColumn("_stem", _path_part(2))
    return rows.where(F.col("Node").isin(list(nodes))) if nodes is not None else rows


def load_responses(
    spark: SparkSession, root: str, nodes: Sequence[str] | None = None, time_format: str | None = None
) -> DataFrame:
    """(Time, Node, Value). The text ``None`` is a label; only an empty field is null."""
    rows = _read(spark, root, RESPONSE_SCHEMA, nodes).where(F.col("_stem") == "responses")
    return rows.select(parse_time(F.col("Time"), time_format).alias("Time"), "Node", "Value")


def load_sensors(
    spark: SparkSession, root: str, nodes: Sequence[str] | None = None, time_format: str | None = None
) -> DataFrame:
    """(Time, Node, sensor, reading): the sensor's name is the file's stem."""
    rows = _read(spark, root, SENSOR_SCHEMA, nodes)
    return rows.select(
        parse_time(F.col("Time"), time_format).alias("Time"), "Node", F.col("_stem").alias("sensor"), "reading"
    )

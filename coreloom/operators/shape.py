"""From sensor and response series to one labelled feature row per timestamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.functions.labels import encode
from coreloom.operators.bounded import small_rows

MAX_COLUMNS = 100_000


def join_responses(sensors: DataFrame, responses: DataFrame) -> DataFrame:
    """Inner join on (Time, Node): timestamps without a response disappear."""
    return sensors.join(responses, ["Time", "Node"], "inner")


def label_per_time(labelled: DataFrame, codes: dict[str, int], nodes: Sequence[str]) -> DataFrame:
    """(Time, Value): the code of the first node, in list order, whose label is known.

    A timestamp whose labels are all unknown stays, with a null code. Nodes missing from the
    list come after all listed ones.
    """
    found = F.array_position(F.lit(list(nodes)), F.col("Node"))
    position = F.when(found > 0, found).otherwise(F.lit(len(nodes) + 1))
    code = encode(F.col("Value"), codes)
    rows = labelled.select("Time", position.alias("_at"), code.alias("_code"))
    return rows.groupBy("Time").agg(
        F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("_at"))).alias("Value")
    )


def find_duplicates(df: DataFrame, keys: Sequence[str] = ("Time", "Node")) -> DataFrame:
    """Every copy of a key that occurs more than once."""
    repeated = df.groupBy(*keys).count().where("count > 1").select(*keys)
    return df.join(repeated, list(keys), "left_semi")


def dedupe_mean(
    df: DataFrame, keys: Sequence[str] = ("Time", "Node"), on_duplicate: str = "mean"
) -> DataFrame:
    """One row per key, every other column averaged over its non-null copies.

    ``on_duplicate='error'`` raises instead when a key repeats.
    """
    if on_duplicate == "error":
        if df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"duplicate keys in {list(keys)}")
        return df
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values])


def sensors_to_long(wide: DataFrame) -> DataFrame:
    """(Time, Node, sensor...) to (Time, Node, sensor, reading); empty cells drop out."""
    sensors = [c for c in wide.columns if c not in ("Time", "Node")]
    cells = F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("reading")) for s in sensors])
    return wide.select("Time", "Node", F.inline(cells)).where("reading is not null")


def sensors_to_wide(long: DataFrame, sensors: Sequence[str] | None = None) -> DataFrame:
    """(Time, Node, sensor, reading) to one column per sensor, aligned by time and node."""
    names = list(sensors) if sensors else sensor_names(long)
    return long.groupBy("Time", "Node").pivot("sensor", names).agg(F.avg("reading"))


def sensor_names(long: DataFrame) -> list[str]:
    found = small_rows(long.select("sensor").distinct(), MAX_COLUMNS, "sensors")
    return sorted(r["sensor"] for r in found)


def feature_columns(long: DataFrame) -> list[str]:
    """All ``{node}_{sensor}`` names of a long table, sorted."""
    found = small_rows(long.select("Node", "sensor").distinct(), MAX_COLUMNS, "feature columns")
    return sorted(f"{r['Node']}_{r['sensor']}" for r in found)


def pivot_features(
    long: DataFrame, columns: Sequence[str] | None = None, on_duplicate: str = "mean"
) -> DataFrame:
    """One row per Time with a ``{node}_{sensor}`` column each; repeats are averaged."""
    if on_duplicate == "error":
        dedupe_mean(long.select("Time", "Node", "sensor"), ("Time", "Node", "sensor"), "error")
    names = list(columns) if columns else feature_columns(long)
    cells = long.select("Time", F.concat_ws("_", "Node", "sensor").alias("_c"), "reading")
    return cells.groupBy("Time").pivot("_c", names).agg(F.avg("reading"))


def pivot_array(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same row per Time as one array, for thousands of columns.

    Cells are averaged per (Time, column) first, so a row's list never exceeds the
    number of columns.
    """
    names = F.lit(list(columns))
    cells = (
        long.select("Time", F.array_position(names, F.concat_ws("_", "Node", "sensor")).alias("_i"), "reading")
        .where("_i > 0")
        .groupBy("Time", "_i")
        .agg(F.avg("reading").alias("_v"))
    )
    by_time = cells.groupBy("Time").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
    indices = F.sequence(F.lit(1).cast("bigint"), F.lit(len(columns)).cast("bigint"))
    return by_time.select("Time", F.transform(indices, lambda i: F.try_element_at(F.col("_m"), i)).alias("features"))


def feature_table(
    sensors: DataFrame,
    responses: DataFrame,
    codes: dict[str, int],
    nodes: Sequence[str],
    columns: Sequence[str] | None = None,
    on_duplicate: str = "mean",
) -> DataFrame:
    """The labelled feature table: join, pivot and one label per Time."""
    labelled = join_responses(sensors, responses)
    features = pivot_features(labelled, columns, on_duplicate)
    return features.join(label_per_time(labelled, codes, nodes), "Time", "inner")


def union_nodes(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack the nodes; a sensor missing at one node is null there."""
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked

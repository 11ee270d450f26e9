"""Sources, label handling, joins and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from coreloom.functions.labels import decode, domain_table, encode
from coreloom.functions.scalars import clean
from coreloom.operators import features as FE
from coreloom.operators import profile, select, shape
from coreloom.plans import standins as S
from coreloom.plans.catalog import sql as Q
from coreloom.plans.catalog.registry import query
from coreloom.session import scratch_path
from coreloom.sources import loader, sinks, stages


def rounded(df, columns, digits=6):
    return df.select(*[clean(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("load_responses", f'WITH {Q.RESPONSES} SELECT "Time", "Node", "Value" FROM responses')
def load_responses(spark, sf):
    root = scratch_path(spark, "responses")
    tree = S.responses(spark, sf).withColumn("file", F.lit("responses.csv"))
    tree.write.partitionBy("Node", "file").option("header", True).csv(root)
    return loader.load_responses(spark, root, S.NODES)


@query("load_sensors_long", f'WITH {Q.SENSORS} SELECT "Time", "Node", sensor, reading FROM sensor_long')
def load_sensors_long(spark, sf):
    root = scratch_path(spark, "sensors")
    tree = S.sensor_long(spark, sf).withColumn("file", F.concat("sensor", F.lit(".csv"))).drop("sensor")
    tree.write.partitionBy("Node", "file").option("header", True).csv(root)
    return loader.load_sensors(spark, root, S.NODES)


_BY_SENSOR = ", ".join(f"{Q.r(f'''avg(reading) FILTER (WHERE sensor = '{s}')''')} AS {s}" for s in Q.EVENT_TYPES)


@query("sensors_wide_by_node", f'WITH {Q.SENSORS} SELECT "Time", "Node", {_BY_SENSOR} FROM sensor_long GROUP BY "Time", "Node"')
def sensors_wide_by_node(spark, sf):
    return rounded(shape.sensors_to_wide(S.sensor_long(spark, sf), Q.EVENT_TYPES), Q.EVENT_TYPES)


@query("union_nodes", f'WITH {Q.SENSORS} SELECT "Time", "Node", {_BY_SENSOR} FROM sensor_long GROUP BY "Time", "Node"')
def union_nodes(spark, sf):
    """Every node's own table with all sensors it has, one under the other."""
    long = S.sensor_long(spark, sf)
    parts = [shape.sensors_to_wide(long.where(F.col("Node") == n), Q.EVENT_TYPES) for n in S.NODES]
    return rounded(shape.union_nodes(parts), Q.EVENT_TYPES)


@query("parse_time", 'SELECT event_id, ts AS "Time" FROM events')
def parse_time(spark, sf):
    rows = S.table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("text"))
    return rows.select("event_id", loader.parse_time(F.col("text")).alias("Time"))


@query(
    "dataset_fingerprint",
    f"""WITH {Q.LINES} SELECT count(*) AS "rows",
    CAST(sum(CAST('0x' || substr(md5(concat_ws('|', row_id, label, CAST(round(l_quantity * 100) AS BIGINT),
      CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT))), 1, 8) AS BIGINT)) AS VARCHAR) AS digest
    FROM lines""",
)
def dataset_fingerprint(spark, sf):
    lines = S.wide_num(spark, sf)
    scaled = [F.round(F.col(c) * 100).cast("bigint") for c in S.NUMERIC]
    return stages.fingerprint(lines, [F.col("row_id"), F.col("label"), *scaled])


_EXPORTED = ", ".join(f"CAST(round({c} * 100) AS BIGINT) AS \"{i}\"" for i, c in enumerate(Q.NUMERIC))


@query(
    "export_datasets",
    f"""WITH {Q.LINES} SELECT 'full_dataset' AS dataset, {_EXPORTED}, CAST(label AS VARCHAR) AS "Value" FROM lines
    UNION ALL SELECT 'core_dataset', {_EXPORTED}, CAST(label AS VARCHAR) FROM lines WHERE md5('42:' || row_id) < '05'""",
)
def export_datasets(spark, sf):
    """Write both feature tables as CSV and read every cell back (in hundredths, which CSV text keeps exactly)."""
    full = S.wide_features(spark, sf)
    tables = {"full_dataset": full, "core_dataset": S.core_of(full)}
    paths = sinks.export_datasets(tables, scratch_path(spark, "export"), dict.fromkeys(tables, 4))
    written = {n: spark.read.option("header", True).csv(p) for n, p in paths.items()}
    cells = [str(i) for i in range(4)]
    rows = profile.tagged(written, [*[F.col(f"`{c}`") for c in cells], "Value"])
    return rows.select("dataset", *[F.round(F.col(f"`{c}`").cast("double") * 100).cast("bigint").alias(c) for c in cells], "Value")


_FOUR = {k: v for k, v in S.EVENT_CODES.items() if k != "view"}


@query(
    "label_encode",
    f"""WITH {Q.RESPONSES} SELECT "Time", "Node", "Value",
    CASE "Value" WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE -1 END AS code
    FROM responses""",
)
def label_encode(spark, sf):
    """Unknown labels encode to null; shown as -1 here."""
    return S.responses(spark, sf).withColumn("code", F.coalesce(encode(F.col("Value"), _FOUR), F.lit(-1)))


@query(
    "label_decode",
    f"""WITH {Q.RESPONSES} SELECT "Time", "Node", {Q.code_case('"Value"')} AS code,
    CASE WHEN "Value" <> 'view' THEN "Value" END AS name FROM responses""",
)
def label_decode(spark, sf):
    coded = S.responses(spark, sf).select("Time", "Node", encode(F.col("Value"), S.EVENT_CODES).alias("code"))
    return coded.withColumn("name", decode(F.col("code"), _FOUR))


@query("cast_float32", f"WITH {Q.LINES} SELECT row_id, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in Q.NUMERIC)} FROM lines")
def cast_float32(spark, sf):
    single = FE.cast_float32(S.wide_features(spark, sf))
    return single.select("row_id", *[F.get("features", F.lit(i)).alias(c) for i, c in enumerate(S.NUMERIC)])


@query("gather_core_rows", f"WITH {Q.LINES} SELECT row_id, label, l_quantity FROM lines WHERE md5('42:' || row_id) < '05'")
def gather_core_rows(spark, sf):
    lines = S.wide_num(spark, sf)
    return select.gather(lines, S.core_of(lines).select("row_id")).select("row_id", "label", "l_quantity")


@query(
    "label_integrity",
    f"""WITH {Q.RESPONSES}, present AS (SELECT DISTINCT {Q.code_case('"Value"')} AS label FROM responses),
    known AS (SELECT * FROM (VALUES (0), (1), (2), (3), (5)) AS k(label))
    SELECT label, 'missing' AS problem FROM known WHERE label NOT IN (SELECT label FROM present)
    UNION ALL SELECT label, 'unexpected' FROM present WHERE label NOT IN (SELECT label FROM known)""",
)
def label_integrity(spark, sf):
    coded = S.responses(spark, sf).select(encode(F.col("Value"), S.EVENT_CODES).alias("label"))
    domain = domain_table(spark, {**_FOUR, "None": 5})
    return profile.label_integrity(coded, domain)


@query("join_sensor_response", f'WITH {Q.LABELLED} SELECT "Time", "Node", sensor, reading, "Value" FROM labelled')
def join_sensor_response(spark, sf):
    return shape.join_responses(S.sensor_long(spark, sf), S.responses(spark, sf))


def feature_table_of(spark, sf):
    return shape.feature_table(S.sensor_long(spark, sf), S.responses(spark, sf), S.EVENT_CODES, S.NODES, Q.CELLS)


_CELLS_SQL = ", ".join(f"{Q.r('p.' + c)} AS {c}" for c in Q.CELLS)


@query(
    "feature_table",
    f"""WITH {Q.PIVOTED} SELECT p."Time", {_CELLS_SQL}, t."Value"
    FROM pivoted p JOIN time_labels t ON p."Time" = t."Time" """,
)
def feature_table(spark, sf):
    return rounded(feature_table_of(spark, sf), Q.CELLS)


@query("feature_projection", f"WITH {Q.PIVOTED} SELECT {_CELLS_SQL} FROM pivoted p")
def feature_projection(spark, sf):
    return rounded(feature_table_of(spark, sf).drop("Time", "Value"), Q.CELLS)


@query("label_per_time", f'WITH {Q.PIVOTED} SELECT "Time", "Value" FROM time_labels')
def label_per_time(spark, sf):
    labelled = shape.join_responses(S.sensor_long(spark, sf), S.responses(spark, sf))
    return shape.label_per_time(labelled, S.EVENT_CODES, S.NODES)


@query(
    "find_duplicates",
    f"""WITH {Q.SENSORS} SELECT "Time", "Node", sensor, reading FROM (
      SELECT *, count(*) OVER (PARTITION BY "Time", "Node", sensor) AS c FROM sensor_long) WHERE c > 1""",
)
def find_duplicates(spark, sf):
    found = shape.find_duplicates(S.sensor_long(spark, sf), ("Time", "Node", "sensor"))
    return found.select("Time", "Node", "sensor", "reading")


@query(
    "dedupe_mean",
    f"""WITH {Q.SENSORS} SELECT "Time", "Node", sensor, {Q.r('avg(reading)')} AS reading
    FROM sensor_long GROUP BY "Time", "Node", sensor""",
)
def dedupe_mean(spark, sf):
    return rounded(shape.dedupe_mean(S.sensor_long(spark, sf), ("Time", "Node", "sensor")), ["reading"])


@query("pivot_features", f'WITH {Q.PIVOTED} SELECT "Time", {_CELLS_SQL} FROM pivoted p')
def pivot_features(spark, sf):
    return rounded(shape.pivot_features(S.sensor_long(spark, sf), Q.CELLS), Q.CELLS)


@query(
    "pivot_features_array",
    f"""WITH {Q.PIVOTED} SELECT "Time", feature, {Q.r('x')} AS x FROM (
      SELECT "Time", unnest([{', '.join(f"'{c}'" for c in Q.CELLS)}]) AS feature,
             unnest([{', '.join(Q.CELLS)}]) AS x FROM pivoted)""",
)
def pivot_features_array(spark, sf):
    rows = FE.to_long(shape.pivot_array(S.sensor_long(spark, sf), Q.CELLS), "Time")
    return rounded(FE.name_features(rows, Q.CELLS), ["x"])

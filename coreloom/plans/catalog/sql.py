"""Shared SQL fragments of the counterparts: the stand-in inputs as CTEs."""

SENSORS = """
sensor_long AS (
  SELECT date_trunc('hour', ts) AS "Time", 'node' || (user_id % 4) AS "Node",
         event_type AS sensor, value AS reading
  FROM events)"""

RESPONSES = """
responses AS (
  SELECT "Time", "Node", event_type AS "Value" FROM (
    SELECT date_trunc('hour', ts) AS "Time", 'node' || (user_id % 4) AS "Node", event_type,
           row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id % 4
                              ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1)"""


def code_case(column: str) -> str:
    return (
        f"CASE {column} WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
        f"WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"
    )


LABELLED = f"""{SENSORS},{RESPONSES},
labelled AS (
  SELECT s."Time", s."Node", s.sensor, s.reading, r."Value"
  FROM sensor_long s JOIN responses r ON s."Time" = r."Time" AND s."Node" = r."Node")"""

NODES = ["node0", "node1", "node2", "node3"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
CELLS = [f"{n}_{s}" for n in NODES for s in EVENT_TYPES]

PIVOTED = f"""{LABELLED},
pivoted AS (
  SELECT "Time", {', '.join(f"avg(reading) FILTER (WHERE \"Node\" || '_' || sensor = '{c}') AS {c}" for c in CELLS)}
  FROM labelled GROUP BY "Time"),
time_labels AS (
  SELECT "Time", CAST(arg_min(code, "Node") AS INTEGER) AS "Value" FROM (
    SELECT "Time", "Node", {code_case('"Value"')} AS code FROM labelled)
  WHERE code IS NOT NULL GROUP BY "Time")"""

LINES = """
lines AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                       CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_id,
         l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS label
  FROM lineitem)"""

PREDICTIONS = f"""{LINES},
predictions AS (
  SELECT row_id, label, CAST(l_quantity AS INTEGER) % 3 AS prediction, l_discount AS score FROM lines)"""

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

LONG = f"""{LINES},
long AS (
  {' UNION ALL '.join(f"SELECT row_id, label, {i} AS f, '{c}' AS feature, {c} AS x FROM lines" for i, c in enumerate(NUMERIC))}),
core AS (SELECT row_id FROM lines WHERE md5('42:' || row_id) < '05'),
core_long AS (SELECT * FROM long WHERE row_id IN (SELECT row_id FROM core))"""

STACKED = f"""{LONG},
stacked AS (
  SELECT feature, x, 1 AS is_full, 0 AS is_other FROM long
  UNION ALL SELECT feature, x, 0, 1 FROM core_long)"""

VECTORS = """
vectors AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""

CELLS_LONG = f"""{VECTORS},
cells AS (
  SELECT row_id, label, generate_subscripts(v, 1) - 1 AS feature, unnest(v) AS x FROM vectors)"""

CENTERS = f"""{CELLS_LONG},
center_cells AS (SELECT label, feature, avg(x) AS m FROM cells GROUP BY label, feature)"""

_SHARES = ", ".join(
    f"count(*) FILTER (WHERE event_type = '{e}') / CAST(count(*) AS DOUBLE) AS p{i}" for i, e in enumerate(EVENT_TYPES)
)
_TERMS = " + ".join(f"CASE WHEN p{i} > 0 THEN -p{i} * ln(p{i}) ELSE 0 END" for i in range(5))

PROBS = f"""
shares AS (SELECT user_id AS row_id, {_SHARES} FROM events GROUP BY user_id),
entropies AS (
  SELECT row_id, p0, p1, p2, p3, p4, round({_TERMS}, 9) + 0.0 AS entropy,
         CASE greatest(p0, p1, p2, p3, p4) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 WHEN p3 THEN 3 ELSE 4 END AS label
  FROM shares)"""

HOURLY = """
hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS t, avg(value) AS value
  FROM events GROUP BY event_type, date_trunc('hour', ts)),
indexed AS (
  SELECT series_id, t, value, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx FROM hourly)"""


def r(expression: str, digits: int = 6) -> str:
    """Rounding used on both sides of a comparison."""
    return f"round({expression}, {digits}) + 0.0"

import os

import pytest
from pyspark.sql import functions as F

from coreloom.functions.labels import ANOMALY_CODES, APPLICATION_CODES, decode, encode
from coreloom.operators import profile, shape
from coreloom.sources import loader, sinks, stages


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Two nodes, two sensors each, as plain files; node1 has a label the domain lacks."""
    root = tmp_path_factory.mktemp("tree")
    responses = {
        "node0": "Time,Value\n2024-01-01 00:00:00,None\n2024-01-01 00:01:00,\n",
        "node1": "Time,Value\n2024-01-01 00:00:00,leak\n2024-01-01 00:01:00,dial\n2024-01-01 00:09:00,odd\n",
    }
    sensors = {
        ("node0", "cpu"): "Time,value\n2024-01-01 00:00:00,1.5\n2024-01-01 00:01:00,2\n",
        ("node0", "mem"): "Time,anything\n2024-01-01 00:00:00,10\n2024-01-01 00:01:00,20\n",
        ("node1", "cpu"): "Time,value\n2024-01-01 00:00:00,3\n2024-01-01 00:00:00,5\n2024-01-01 00:09:00,7\n",
        ("node2", "cpu"): "Time,value\n2024-01-01 00:00:00,99\n",
    }
    for node, text in responses.items():
        os.makedirs(root / "responses" / node)
        (root / "responses" / node / "responses.csv").write_text(text)
    for (node, name), text in sensors.items():
        os.makedirs(root / "sensors" / node, exist_ok=True)
        (root / "sensors" / node / f"{name}.csv").write_text(text)
    (root / "sensors" / "node0" / "notes.txt").write_text("not a sensor")
    return str(root)


NODES = ["node0", "node1"]


def test_load_responses_keeps_the_none_label(spark, tree):
    rows = loader.load_responses(spark, f"{tree}/responses", NODES)
    assert rows.count() == 5
    assert rows.where("Value = 'None'").count() == 1 and rows.where("Value is null").count() == 1
    assert dict(rows.dtypes)["Time"] == "timestamp_ntz"


def test_load_sensors_names_the_column_after_the_file(spark, tree):
    rows = loader.load_sensors(spark, f"{tree}/sensors", NODES)
    got = {(r["Node"], r["sensor"]) for r in rows.collect()}
    assert got == {("node0", "cpu"), ("node0", "mem"), ("node1", "cpu")}
    wide = shape.sensors_to_wide(rows).where("Node = 'node0'").orderBy("Time").collect()
    assert [(r["cpu"], r["mem"]) for r in wide] == [(1.5, 10.0), (2.0, 20.0)]


def test_malformed_time_fails(spark):
    df = spark.createDataFrame([("yesterday",)], "t string")
    with pytest.raises(Exception):
        df.select(loader.parse_time(F.col("t"))).collect()


def test_feature_table(spark, tree):
    sensors = loader.load_sensors(spark, f"{tree}/sensors", NODES)
    responses = loader.load_responses(spark, f"{tree}/responses", NODES)
    rows = shape.feature_table(sensors, responses, ANOMALY_CODES, NODES).orderBy("Time").collect()
    assert rows[0].asDict().keys() == {"Time", "node0_cpu", "node0_mem", "node1_cpu", "Value"}
    assert [(r["node0_cpu"], r["node1_cpu"], r["Value"]) for r in rows] == [(1.5, 4.0, 0), (2.0, None, None), (None, 7.0, None)]
    with pytest.raises(ValueError):
        shape.pivot_features(sensors, on_duplicate="error")


def test_label_per_time_takes_the_first_known(spark):
    rows = spark.createDataFrame(
        [("t", "node0", None), ("t", "node1", "leak"), ("t", "node2", "dial"), ("u", "node2", "odd")],
        "Time string, Node string, Value string",
    )
    got = {r["Time"]: r["Value"] for r in shape.label_per_time(rows, ANOMALY_CODES, ["node0", "node1", "node2"]).collect()}
    assert got == {"t": 2, "u": None}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (2, "a", None), (2, "b", 4.0)], "Time int, Node string, x double")
    assert shape.find_duplicates(df).count() == 2
    assert shape.dedupe_mean(df).where("Time = 1").first()["x"] == 2.0
    with pytest.raises(ValueError):
        shape.dedupe_mean(df, on_duplicate="error")


def test_wide_and_array_pivots_agree(spark, tree):
    sensors = loader.load_sensors(spark, f"{tree}/sensors", NODES)
    columns = shape.feature_columns(sensors)
    wide = {r["Time"]: [r[c] for c in columns] for r in shape.pivot_features(sensors, columns).collect()}
    arrays = {r["Time"]: list(r["features"]) for r in shape.pivot_array(sensors, columns).collect()}
    assert wide == arrays


def test_union_fills_missing_sensors(spark):
    a = spark.createDataFrame([(1, "n0", 1.0)], "Time int, Node string, cpu double")
    b = spark.createDataFrame([(1, "n1", 2.0)], "Time int, Node string, mem double")
    rows = shape.union_nodes([a, b]).orderBy("Node").collect()
    assert rows[0]["mem"] is None and rows[1]["cpu"] is None
    assert shape.sensors_to_long(shape.union_nodes([a, b])).count() == 2


@pytest.mark.parametrize("codes", [ANOMALY_CODES, APPLICATION_CODES])
def test_label_codes_round_trip(spark, codes):
    df = spark.createDataFrame([(n,) for n in [*codes, "unknown"]], "name string")
    coded = df.withColumn("code", encode(F.col("name"), codes)).withColumn("back", decode(F.col("code"), codes))
    for row in coded.collect():
        assert row["code"] == codes.get(row["name"])
        assert row["back"] == (row["name"] if row["name"] in codes else None)


def test_export_round_trip(spark, vectors, tmp_path):
    paths = sinks.export_for_tsne(vectors, vectors.limit(5), vectors.limit(2), str(tmp_path / "out"), 4)
    back = spark.read.option("header", True).option("inferSchema", True).csv(paths["full_dataset"])
    assert back.columns == ["0", "1", "2", "3", "label"] and back.count() == 120
    want = sorted(tuple(r["features"]) for r in vectors.collect())
    assert sorted(tuple(r)[:4] for r in back.collect()) == want
    assert spark.read.option("header", True).csv(paths["stratified_core_dataset"]).count() == 2


def test_report_is_one_file(spark, tmp_path):
    path = sinks.feature_log_path(str(tmp_path), "pca")
    assert path.endswith("feature_similarity_logs_pca.csv")
    log = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "feature string, ks_stat double")
    sinks.write_report(log.repartition(2), path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    assert spark.read.option("header", True).csv(path).count() == 2


def test_stages_are_reused(spark, vectors, tmp_path):
    store = stages.Stages(spark, str(tmp_path / "stages"))
    calls = []

    def build():
        calls.append(1)
        return vectors

    params = {"seed": 42, "data": stages.feature_fingerprint(vectors)}
    assert store.load("scaled", params) is None
    assert store.get_or_build("scaled", params, build).count() == 120
    assert store.get_or_build("scaled", dict(reversed(params.items())), build).count() == 120
    assert len(calls) == 1
    store.get_or_build("scaled", {**params, "seed": 1}, build)
    assert len(calls) == 2


def test_a_stage_without_its_marker_is_built_again(spark, vectors, tmp_path):
    store = stages.Stages(spark, str(tmp_path / "stages"))
    first = store.table("step", {"a": 1}, lambda: vectors, lambda: {"kept": [0, 2]})
    assert (first.rows, first.note, first.reused) == (120, {"kept": [0, 2]}, False)
    again = store.table("step", {"a": 1}, lambda: vectors.limit(1))
    assert again.reused and again.digest == first.digest and again.note == first.note and again.table.count() == 120
    (tmp_path / "stages" / "step" / (first.key + ".done")).rename(tmp_path / "lost")
    assert store.load("step", {"a": 1}) is None
    assert store.table("step", {"a": 1}, lambda: vectors.repartition(5)).digest == first.digest
    empty = store.table("step", {"a": 2}, lambda: vectors.limit(0))
    assert empty.rows == 0 and empty.digest != first.digest
    assert stages.content_key(vectors) == stages.content_key(vectors.repartition(3)) != stages.content_key(vectors.limit(5))


def test_fingerprint_ignores_order_but_not_content(vectors):
    same = stages.feature_fingerprint(vectors.repartition(7))
    assert stages.feature_fingerprint(vectors) == same
    assert stages.feature_fingerprint(vectors.where("row_id > 0")) != same


def test_label_integrity(spark):
    domain = spark.createDataFrame([(0, "a"), (1, "b")], "label int, name string")
    df = spark.createDataFrame([(0,), (7,)], "label int")
    got = {(r["label"], r["problem"]) for r in profile.label_integrity(df, domain).collect()}
    assert got == {(1, "missing"), (7, "unexpected")}


def test_unlisted_node_comes_last(spark):
    from coreloom.operators import shape

    rows = spark.createDataFrame([(1, "n0", "A"), (1, "zz", "B"), (2, "zz", "B")], "Time int, Node string, Value string")
    got = {r["Time"]: r["Value"] for r in shape.label_per_time(rows, {"A": 0, "B": 1}, ["n0"]).collect()}
    assert got == {1: 0, 2: 1}


def test_large_summary_is_not_pinned(spark):
    from pyspark.sql import functions as F

    from coreloom.operators.bounded import pin_small

    wide = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: i * 1.5).alias("a"))
    assert "broadcast" in pin_small(wide)._jdf.queryExecution().logical().toString().lower()
    far = pin_small(wide, max_bytes=50_000)
    assert "broadcast" not in far._jdf.queryExecution().logical().toString().lower() and far.count() == 40
    assert pin_small(wide, max_rows=39).count() == 40


def test_cluster_needs_a_shared_folder():
    from coreloom.session import scratch_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session())

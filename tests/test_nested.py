"""Least rows and equal cells by hash aggregates: the same rows as by comparing whole ones."""

import random

from pyspark.sql import functions as F

from coreloom.operators import cells, select
from coreloom.plans.catalog import models as catalog


def test_least_rows_are_found_in_two_steps(spark):
    rows = [(9, 0, 1.0), (4, 0, 1.0), (5, 0, 2.0), (1, None, 3.0), (2, None, 3.0), (7, 1, None), (8, 1, 0.5), (3, 2, float("nan"))]
    df = spark.createDataFrame(rows, "row_id int, cluster int, distance double")
    once, twice = (sorted(map(str, select.closest(df, twice=t).collect())) for t in (False, True))
    assert once == twice and len(once) == 4
    plan = df.groupBy("cluster").agg(F.min("distance"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_cells_of_equal_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [-0.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "cell int, features array<double>")
    found = df.groupBy("cell").agg(select._one_point(2).alias("p"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["cell"]: r["p"] for r in found.collect()} == {0: True, 1: False, 2: True}


def test_the_core_set_of_a_twentieth_uses_no_table_of_centres(spark, vectors, monkeypatch):
    monkeypatch.setattr(select, "fit_kmeans", None)
    core = catalog.core_rows(vectors)
    assert core.columns == ["row_id", "label", "features"] and 3 <= core.count() <= 6


def test_hashes_are_those_of_spark(spark):
    rows = [([1.5, -0.0], 1), ([0.0, float("nan")], 2), ([None, 3.0], 3), (None, 4)]
    df = spark.createDataFrame(rows, "x array<double>, i int").select(
        "i", F.xxhash64("x").alias("h"), *[F.xxhash64("x", F.lit(seed)).alias(f"h{seed}") for seed in (42, 2**31 - 1)]
    )
    found = df.orderBy("i").toPandas()
    for seed in (42, 2**31 - 1):
        assert cells.hashed(found["h"].to_numpy(), seed).tolist() == found[f"h{seed}"].tolist()


def _clusters(df, k):
    rows, centers = select.nested_clusters(df, k, seed=7)
    return (
        {r["row_id"]: (r["cluster"], None if r["distance"] is None else round(r["distance"], 9)) for r in rows.collect()},
        sorted(str((r["cluster"], [None if x is None else round(x, 9) for x in r["center"]])) for r in centers.collect()),
    )


def test_a_task_takes_the_steps_that_spark_takes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.choice([0.0, 4.0, 9.0]) + rng.random(), float(rng.randrange(5))]) for i in range(800)]
    rows += [(800 + i, 0, [20.0, 20.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    whole = _clusters(df, 60)
    monkeypatch.setattr(select, "TASK_VALUES", 600)  # cells of over 300 rows take their steps as Spark jobs, the others in a task each
    monkeypatch.setattr(select, "held", lambda centers: (centers, None))  # and the rows bring their centres
    assert _clusters(df, 60) == whole
    assert len(whole[0]) == 1200 and len(whole[1]) <= 60


def test_missing_values_have_no_distance(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    odd = [[None, 1.0], [1.0, None], [nan, 2.0], [inf, 1.0], [-inf, 0.0], [None, None]]
    rows = [(i, 0, [float(i % 7), float(i % 11)]) for i in range(80)] + [(100 + i, 0, x) for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>").cache()
    few = str(_clusters(df, 8))
    monkeypatch.setattr(select, "TASK_VALUES", 60)
    assert str(_clusters(df, 8)) == few
    assert "(None, None)" in few


def test_few_jobs_for_a_table_that_a_task_can_hold(spark, vectors):
    tracker, group = spark.sparkContext.statusTracker(), "nested"
    spark.sparkContext.setJobGroup(group, group)
    try:
        select.kmeans_core_set(vectors, 40, method="nested").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(tracker.getJobIdsForGroup(group)) <= 30

"""The entry points, and invariants of queries SQL cannot express."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coreloom.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors_in(spark):
    return spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()


def test_entry_reports_every_class(spark):
    report = entry.entry(spark)
    assert report.count() == 10 and report.agg(F.sum("core_rows")).first()[0] <= 5


def test_names():
    names = entry.queries()
    assert len(QUERIES) > 100 and set(QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


def test_kmeans_assigns_every_row(spark, vectors_in):
    rows = QUERIES["kmeans_fit"](spark, SF_DIR)
    assert rows.count() == vectors_in and rows.select("cluster").distinct().count() <= 10


def test_elbow_falls(spark):
    inertia = [r["inertia"] for r in QUERIES["kmeans_elbow"](spark, SF_DIR).orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True)


def test_components_needed(spark):
    rows = QUERIES["pca_components_needed"](spark, SF_DIR).orderBy("component").collect()
    needed = rows[0]["needed"]
    assert rows[needed - 1]["cumulative"] >= 0.95 > rows[needed - 2]["cumulative"]


def test_similarity_p_values(spark):
    rows = QUERIES["statistical_similarity"](spark, SF_DIR).collect()
    assert len(rows) == 4
    assert all(0 <= r["ks_p"] <= 1 and 0 <= r["t_p"] <= 1 and 0 <= r["ks_stat"] <= 1 for r in rows)


def test_pacf_starts_with_the_acf(spark):
    acf = {(r["series_id"], r["lag"]): r["acf"] for r in QUERIES["acf"](spark, SF_DIR).collect()}
    pacf = {(r["series_id"], r["lag"]): r["pacf"] for r in QUERIES["pacf"](spark, SF_DIR).collect()}
    assert set(acf) == set(pacf)
    assert all(abs(pacf[k] - acf[k]) < 1e-6 for k in acf if k[1] <= 1)
    assert all(abs(v) <= 1 + 1e-9 for v in pacf.values())


def test_clustering_report(spark):
    rows = {r["measure"]: r["value"] for r in QUERIES["clustering_report"](spark, SF_DIR).collect()}
    assert -1 <= rows["silhouette"] <= 1 and rows["davies_bouldin"] > 0


def test_cells_keep_about_one_row_in_a_hundred(spark):
    rows = QUERIES["kmeans_core_set_cells"](spark, SF_DIR)
    assert 30 <= rows.count() <= 80
    assert rows.select("row_id").distinct().count() == rows.count()

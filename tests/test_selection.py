from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from coreloom.operators import models, reduce, select
from coreloom.plans import workflow
from coreloom.sources.stages import Stages


def test_equal_thresholds_select_every_row_twice(spark):
    df = spark.range(20).select(F.col("id").alias("row_id"), F.lit(0.0).alias("entropy"))
    assert select.entropy_bands(df).groupBy("band").count().collect()[0]["count"] == 20
    assert select.entropy_bands(df).count() == 40


def test_entropy_tails(spark):
    df = spark.range(101).select(F.col("id").alias("row_id"), (F.col("id") / 100.0).alias("entropy"))
    got = {r["row_id"]: r["band"] for r in select.entropy_bands(df).collect()}
    assert got == {0: "low", 1: "low", 99: "high", 100: "high"}


def test_nearest_row_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(3, 0, [1.0]), (1, 0, [-1.0]), (2, 0, [5.0]), (9, 1, [7.0])], "row_id int, cluster int, features array<double>")
    centers = spark.createDataFrame([(0, [0.0]), (1, [7.0]), (2, [99.0])], "cluster int, center array<double>")
    got = {r["cluster"]: r["row_id"] for r in select.nearest_to_center(rows, centers).collect()}
    assert got == {0: 1, 1: 9}


def test_kmeans_core_set_has_one_row_per_cluster(vectors):
    core = select.kmeans_core_set(vectors, 3)
    assert {r["label"] for r in core.collect()} == {0, 1, 2} and core.count() == 3


def test_one_cluster_picks_the_row_nearest_the_mean(spark):
    df = spark.createDataFrame([(i, [float(i * i)]) for i in range(6)], "row_id int, features array<double>")
    assert [r["row_id"] for r in select.kmeans_core_set(df, 1).collect()] == [3]


def test_more_clusters_than_points(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(10)], "row_id int, features array<double>")
    core = select.kmeans_core_set(df, 6)
    assert core.count() <= 2 and core.where("features is null").count() == 0


def test_nested_clusters_cover_any_number_of_groups(spark):
    """A third of the rows are copies of one point."""
    rng = np.random.default_rng(4)
    points = [(i, i % 2, [0.0, 0.0] if i % 3 == 0 else rng.normal(size=2).tolist()) for i in range(3000)]
    df = spark.createDataFrame(points, "row_id bigint, label int, features array<double>")
    core = select.kmeans_core_set(df, 200, method="nested").collect()
    chosen = [r["row_id"] for r in core]
    assert len(chosen) == len(set(chosen)) == len({r["cluster"] for r in core})
    assert 80 <= len(chosen) <= 200
    everything = np.array([p for *_, p in points])
    gap = np.sqrt(((everything[:, None] - everything[chosen][None]) ** 2).sum(-1)).min(axis=1)
    assert gap.mean() < 0.25


def test_nested_clusters_with_a_crowded_cell(spark, monkeypatch):
    """A third of the rows crowd round one place: its cell is divided on, and no summary is broadcast."""
    from coreloom.operators import bounded

    monkeypatch.setattr(bounded, "MAX_PINNED_ROWS", 0)
    monkeypatch.setattr(bounded, "HOT_PART", 10)
    rng = np.random.default_rng(6)
    spots = rng.normal(size=(30, 2)) * 100
    points = [(i, i % 2, (rng.normal(size=2) if i % 3 == 0 else spots[i % 30] + rng.normal(size=2)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(points, "row_id bigint, label int, features array<double>").coalesce(1)
    assigned, centers = select.nested_clusters(df, 300)
    sizes = assigned.groupBy("cluster").count().agg(F.count(F.lit(1)), F.sum("count"), F.max("count")).first()
    assert sizes[1] == 3000 and 200 <= sizes[0] <= 300 and sizes[2] < 150
    assert centers.count() <= 300 and centers.select("cluster").distinct().count() == centers.count()
    near = [i for i, _, x in points if np.hypot(*x) < 4]
    inside = assigned.where(F.col("row_id").isin(near)).select("cluster").distinct().count()
    assert inside >= 60  # about a third of the clusters, as of the rows
    equal = spark.range(500).select(F.col("id").alias("row_id"), F.lit(0).alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("features"))
    assert select.kmeans_core_set(equal, 90, method="nested").count() == 1


def test_the_method_is_the_callers_choice_at_every_size(spark):
    """Below and above a thousand clusters: the same columns, one row per cluster, each nearest to its centre."""
    rng = np.random.default_rng(5)
    rows = [(i, 0, [float(i // 2), float(rng.normal())]) for i in range(2200)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    schemas = set()
    for k in (990, 1010):
        for method in ("lloyd", "nested"):
            core = select.kmeans_core_set(df, k, method=method)
            schemas.add(core.schema.simpleString())
            found = core.collect()
            assert len({r["cluster"] for r in found}) == len(found) == len({r["row_id"] for r in found}) <= k
    assert len(schemas) == 1
    assigned, centers = select.nested_clusters(df, 50)
    at = {r["cluster"]: np.array(r["center"]) for r in centers.collect()}
    best = {}
    for r in assigned.collect():
        d = float(np.linalg.norm(np.array(r["features"]) - at[r["cluster"]]))
        best[r["cluster"]] = min(best.get(r["cluster"], (np.inf, 0)), (d, r["row_id"]))
    picked = {r["cluster"]: r["row_id"] for r in select.kmeans_core_set(df, 50, method="nested").collect()}
    assert picked == {c: i for c, (_, i) in best.items()}
    with pytest.raises(ValueError):
        select.kmeans_core_set(df, 5, method="other")


def test_forest_learns_and_importances_sum_to_one(spark, vectors):
    model = models.fit_forest(vectors, models.Forest(trees=10, depth=5))
    scored = models.predict(model, vectors)
    assert scored.where("label = prediction").count() >= 115
    row = scored.first()
    assert abs(sum(row["probability"]) - 1) < 1e-9 and len(row["probability"]) == 3
    table = models.importances(model, ["a", "b", "c", "d"], spark)
    assert abs(table.agg(F.sum("importance")).first()[0] - 1) < 1e-9
    assert models.top_features(table, 2).count() == 2
    assert models.importance_difference(table, table, 3).agg(F.max(F.abs("difference"))).first()[0] == 0


def test_cross_validation(vectors):
    folds = models.cross_validate(vectors, models.Forest(trees=5, depth=4), 3)
    assert folds.count() == 3
    summary = models.cv_summary(folds).first()
    assert summary["accuracy_mean"] > 0.9 and summary["accuracy_std"] >= 0


def test_components(vectors):
    pca = reduce.fit_pca(vectors, 0.95)
    assert sum(pca.explained[: pca.k]) >= 0.95
    assert pca.k == 1 or sum(pca.explained[: pca.k - 1]) < 0.95
    scores = np.array([r["features"] for r in pca.transform(vectors).collect()])
    assert scores.shape == (120, pca.k) and np.abs(scores.mean(axis=0)).max() < 1e-9
    x = np.array([r["features"] for r in vectors.collect()])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(scores.var(axis=0), values[: pca.k])
    table = pca.variance_table(vectors.sparkSession).orderBy("component").collect()
    assert abs(table[-1]["cumulative"] - 1) < 1e-9


def small(plan):
    few = models.Forest(trees=5, depth=4)
    return replace(plan, full=few, core=few, compressed=few, clusters=6, fraction=max(plan.fraction, 0.2))


@pytest.mark.parametrize("name", ["anomaly_entropy_stratified", "anomaly_kmeans_pca", "application_kmeans_stratified"])
def test_workflow(vectors, name):
    timed = vectors.withColumn("Time", F.col("row_id"))
    run = workflow.run(timed, small(workflow.PLANS[name]), ["a", "b", "c", "d"])
    assert run.names == ["a", "b", "c"]
    summary = {r["dataset"]: r for r in run.summary().collect()}
    assert summary["full"]["rows"] == 96 and summary["full"]["compression_ratio"] == 1
    assert summary["core"]["rows"] <= 96 and summary["full"]["accuracy"] > 0.8
    assert run.report().where("name = 'accuracy'").count() == 3
    assert run.class_test().first()["dof"] == 2
    assert run.similarity_log(2).count() == 2
    stages = [r["stage"] for r in run.timings().collect()]
    assert stages[0] == "train" and "fit_compressed" in stages


@pytest.mark.parametrize("name", ["anomaly_kmeans_pca", "application_entropy_stratified"])
def test_a_second_run_fits_nothing(spark, vectors, name, tmp_path, monkeypatch):
    store = Stages(spark, str(tmp_path))
    plan = small(workflow.PLANS[name])
    timed = vectors.withColumn("Time", F.col("row_id"))
    names = ["a", "b", "c", "d"]
    first = workflow.run(timed, plan, names, store=store)
    want = sorted(map(str, first.report().collect()))
    assert not any(r["reused"] for r in first.timings().collect())

    def refuse(*_):
        raise AssertionError("fitted again")

    fitting = [(models, "fit_forest"), (workflow, "fit_pca"), (select, "kmeans_core_set"), (workflow.FE, "fit_scaler")]
    with monkeypatch.context() as patched:
        for module, fit in fitting:
            patched.setattr(module, fit, refuse)
        again = workflow.run(timed.repartition(3), plan, names, store=store)
        assert all(r["reused"] for r in again.timings().collect())
        assert sorted(map(str, again.report().collect())) == want and again.names == first.names
        cell = F.when(F.col("row_id") == 5, F.array(*[F.lit(x) for x in (9.0, 1.0, 0.0, 3.0)])).otherwise(F.col("features"))
        with pytest.raises(AssertionError, match="fitted again"):
            workflow.run(timed.withColumn("features", cell), plan, names, store=store)
    other = workflow.run(timed, replace(plan, compressed=models.Forest(trees=3, depth=2)), names, store=store)
    assert [r["stage"] for r in other.timings().collect() if not r["reused"]] == ["fit_compressed", "predictions"]


def test_too_small_samples_are_refused(vectors):
    plan = replace(small(workflow.PLANS["anomaly_entropy_stratified"]), fraction=0.001)
    with pytest.raises(ValueError, match="too small"):
        workflow.run(vectors, plan, ["a", "b", "c", "d"])
    with pytest.raises(ValueError, match="no rows"):
        models.fit_forest(vectors.limit(0), models.Forest())
    from coreloom.operators.features import class_weight

    assert vectors.limit(0).select(class_weight(vectors.limit(0)).alias("w")).dtypes == [("w", "double")]


def test_evaluation_of_a_run(vectors):
    run = workflow.run(vectors, small(workflow.PLANS["anomaly_kmeans_pca"]), ["a", "b", "c", "d"])
    points = run.roc().collect()
    assert {(r["model"], r["class"]) for r in points} == {(m, c) for m in ("full", "core", "compressed") for c in range(3)}
    starts = [r for r in points if r["threshold"] is None]
    assert len(starts) == 9 and all(r["fpr"] == 0 and r["tpr"] == 0 for r in starts)
    assert all(r["auc"] > 0.9 for r in run.auc().where("model = 'full'").collect())
    assert run.leakage().first()["overlap"] == 0
    assert run.cross_validation("full", 3).count() == 3
    assert run.importance_difference(2).count() == 2
    shares = run.component_importances()
    assert shares.count() == run.components.k and abs(shares.agg(F.sum("importance")).first()[0] - 1) < 1e-9
    assert {r["measure"] for r in run.clustering(3).collect()} == {"silhouette", "davies_bouldin"}
    assert run.core_report().agg(F.sum("core_rows")).first()[0] == run.core.count()


def test_plans_cover_both_applications():
    plans = workflow.PLANS.values()
    assert len({(p.split, p.select, p.compress) for p in plans}) == 8
    assert workflow.PLANS["anomaly_kmeans_pca"].cluster_count(62357) == 623
    assert workflow.PLANS["application_kmeans_stratified"].cluster_count(62357) == 500

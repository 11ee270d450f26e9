"""Forests whose nodes stay in tables: the same rows at any partitioning, bounded cells, every row scored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coreloom.operators import forest as FO
from coreloom.operators import models


@pytest.fixture(scope="module")
def noisy(spark):
    """Five features; the label is a band of the first, wrong for a tenth of the rows; keys repeat, one is null."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        x = rng.normal(size=5).tolist()
        label = int(x[0] > -0.4) + int(x[0] > 0.5)
        rows.append((None if i == 5 else i // 2, int(rng.integers(3)) if i % 10 == 0 else label, x))
    return spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")


def outcome(model, df):
    rows = models.predict(model, df).select("features", "probability", "prediction").collect()
    return {tuple(r["features"]): (tuple(r["probability"]), r["prediction"]) for r in rows}


def test_the_partitioning_changes_nothing_and_every_row_is_scored(spark, noisy, tmp_path):
    settings = models.Forest(trees=6, min_leaf=2, impurity="entropy")
    model = models.fit_forest(noisy, settings)
    scored = models.predict(model, noisy)
    assert scored.columns == ["row_id", "label", "features", "probability", "prediction"]
    rows = scored.collect()
    assert len(rows) == 600 and sum(r["row_id"] is None for r in rows) == 1
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and np.argmax(r["probability"]) == r["prediction"] for r in rows)
    assert sum(r["label"] == r["prediction"] for r in rows) > 510
    other = models.fit_forest(noisy.repartition(7), settings)
    assert outcome(model, noisy) == outcome(other, noisy.coalesce(1))
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = FO.ForestModel.load(str(tmp_path / "model"))
    assert outcome(loaded, noisy) == outcome(model, noisy)
    assert loaded.feature_importances() == pytest.approx(model.feature_importances())


def test_nodes_are_a_table_of_bounded_cells(spark, noisy, monkeypatch):
    """Trees are divided above cells of 100 points, and rows are scored in groups."""
    settings = models.Forest(trees=5, min_leaf=2)
    whole = models.fit_forest(noisy, settings)
    assert whole.nodes.count() == 5 and all(t.feature == [-1] for t in whole.tops)
    monkeypatch.setattr(FO, "CELL_POINTS", 100)
    monkeypatch.setattr(FO, "PASS_COUNTS", 600)
    model = models.fit_forest(noisy, settings)
    assert model.nodes.groupBy("tree").count().agg(F.min("count")).first()[0] >= 3
    monkeypatch.setattr(FO, "GROUP_BYTES", 13 * 200)
    monkeypatch.setattr(FO, "BLOCK_BYTES", 1)
    rows = models.predict(model, noisy).collect()
    assert len(rows) == 600 and sum(r["label"] == r["prediction"] for r in rows) > 500
    found, plain = model.feature_importances(), whole.feature_importances()
    assert abs(sum(found) - 1) < 1e-9 and np.argmax(found) == np.argmax(plain) == 0
    assert abs(found[0] - plain[0]) < 0.15


def test_a_cell_is_divided_as_a_tree_by_hand_would_be():
    bins = np.array([[0, 3], [1, 3], [2, 3], [3, 3]], np.uint8)
    labels, copies = np.array([0, 0, 1, 1]), np.array([2, 1, 1, 3])
    settings = models.Forest(trees=1)
    for seed in range(20):
        got = FO.grow(bins, labels, copies, 30, 2, np.ones(2), settings, np.random.default_rng(seed))
        arrays = [np.frombuffer(got[n], t) for n, t in (("feature", np.int32), ("cut", np.uint8), ("left", np.int32))]
        leaf = (np.cumsum(arrays[0] < 0) - 1)[FO.descend(bins, *arrays)]
        shares = np.frombuffer(got["shares"]).reshape(-1, 2)[leaf]
        assert shares.argmax(axis=1).tolist() == [0, 0, 1, 1] and arrays[0][0] == 0 and arrays[1][0] == 1
        total = 7 - (3 * 3 + 4 * 4) / 7
        assert got["importance"] == pytest.approx([total, 0.0])
    small = FO.grow(bins, labels, copies, 30, 2, np.ones(2), models.Forest(min_leaf=4), np.random.default_rng(1))
    assert np.frombuffer(small["feature"], np.int32).tolist() == [-1]
    flat = FO.grow(bins, labels, copies, 0, 2, np.array([1.0, 0.5]), settings, np.random.default_rng(1))
    assert np.frombuffer(flat["shares"]).tolist() == pytest.approx([3 / 5, 2 / 5])


def test_cuts_and_bad_rows(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i % 3), float(i), 7.0]) for i in range(200)], "row_id int, label int, features array<double>")
    few, many, one = FO.find_cuts(df)
    assert few == [0.5, 1.5] and one == [] and 25 <= len(many) <= 31
    for broken in ("array(1D, null, 2D)", "array(1D)", "cast(null as array<double>)"):
        bad = df.withColumn("features", F.when(F.col("row_id") == 3, F.expr(broken)).otherwise(F.col("features")))
        with pytest.raises(Exception, match="known features"):
            models.fit_forest(bad, models.Forest(trees=1)).nodes.count()
    for label in (-1, None, 100):
        with pytest.raises(Exception, match="whole numbers"):
            models.fit_forest(df.withColumn("label", F.when(F.col("row_id") == 3, F.lit(label)).otherwise(F.col("label"))), models.Forest(trees=1))


def test_scoring_broadcasts_no_rows(spark, noisy):
    """Tables that grow with the rows never pass the driver."""
    scored = models.predict(models.fit_forest(noisy, models.Forest(trees=3)), noisy)
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == 600


def test_the_different_rows_are_routed_by_more_than_one_task(spark, noisy, monkeypatch):
    files, write = {}, FO.materialize

    def noted(df, name):
        files[name] = write(df, name)
        return files[name]

    monkeypatch.setattr(FO, "materialize", noted)
    assert models.predict(models.fit_forest(noisy, models.Forest(trees=3)), noisy).count() == 600
    assert len(files["different"].inputFiles()) > 1


def test_bags_are_the_draws_of_a_stream_per_point_from_one_generator(monkeypatch):
    ids, copies = np.array([-(2**63), -1, 0, 1, 2**63 - 1, 77, -1], np.int64), np.array([1, 2, 1, 15, 300, 1, 2])

    def own(key, n, seed):
        return np.random.Generator(np.random.Philox(key=(key & 0xFFFFFFFFFFFFFFFF) | (seed & 0xFFFFFFFF) << 64)).poisson(n, 33)

    for seed in (42, -7):
        wanted = [own(k, n, seed) for k, n in zip(ids.tolist(), copies.tolist())]
        assert np.array_equal(FO._bags(ids, copies, 33, seed), wanted)
    made, plain = [], np.random.Philox
    monkeypatch.setattr(np.random, "Philox", lambda *a, **k: made.append(1) or plain(*a, **k))
    FO._bags(ids, copies, 33, 42)
    assert len(made) == 1


def test_a_cell_scores_all_its_blocks_in_one_descent(spark, noisy, monkeypatch):
    """Blocks of 64 rows: rows and scores are those of a single block."""
    model = models.fit_forest(noisy, models.Forest(trees=4, min_leaf=2))
    whole = outcome(model, noisy)
    monkeypatch.setattr(FO, "BLOCK_BYTES", 1)
    assert outcome(model, noisy) == whole


def test_descent_ends_where_a_walk_ends():
    feature, cut = np.array([1, -1, 0, -1, -1], np.int32), np.array([3, 0, 7, 0, 0], np.uint8)
    left = np.array([1, 0, 3, 0, 0], np.int32)
    bins = np.array([[0, 3], [7, 4], [8, 4], [31, 0]], np.uint8)
    assert FO.descend(bins, feature, cut, left).tolist() == [1, 3, 4, 1]
    assert FO.descend(bins[:0], feature, cut, left).tolist() == []
    assert FO.descend(bins, *(a[1:2] for a in (feature, cut, left))).tolist() == [0, 0, 0, 0]

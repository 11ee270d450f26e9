import math

import pytest
from pyspark.sql import functions as F

from coreloom.operators import features as FE
from coreloom.operators import split


def test_largest_remainder():
    assert split.largest_remainder({"a": 50, "b": 30, "c": 20}, 7) == {"a": 4, "b": 2, "c": 1}
    assert sum(split.largest_remainder({0: 1, 1: 1, 2: 1}, 2).values()) == 2


def test_largest_remainder_with_minimum():
    assert split.largest_remainder({0: 97, 1: 2, 2: 1}, 5, min_per_class=1) == {0: 3, 1: 1, 2: 1}


@pytest.fixture(scope="module")
def uneven(spark):
    """One class holds most of the rows, one has three."""
    rows = [(i, 0 if i < 300 else (1 if i < 397 else 2)) for i in range(400)]
    return spark.createDataFrame(rows, "row_id bigint, label int")


def test_split_sizes_and_disjointness(uneven):
    train, test = split.stratified_split(uneven, 0.2)
    assert test.count() == math.ceil(0.2 * 400) and train.count() == 320
    assert train.intersect(test).count() == 0
    assert split.class_sizes(test) == {0: 60, 1: 19, 2: 1}


def test_ordered_folds(spark):
    rows = [(n, "a" if n % 3 else "b") for n in range(20)]
    df = spark.createDataFrame(rows, "row_id bigint, label string")
    got = {r["row_id"]: r["fold"] for r in split.ordered_folds(df, 4).collect()}
    # 13 rows of a: folds take positions 0, 4, .. of the 20 laid end to end, so 4 3 3 3; 7 of b from position 13: 1 2 2 2.
    a, b = [n for n, c in rows if c == "a"], [n for n, c in rows if c == "b"]
    assert [got[n] for n in a] == [0] * 4 + [1] * 3 + [2] * 3 + [3] * 3
    assert [got[n] for n in b] == [0] * 1 + [1] * 2 + [2] * 2 + [3] * 2
    assert split.ordered_folds(df, 4).columns == ["row_id", "label", "fold"]


def test_folds(uneven):
    rows = split.stratified_folds(uneven, 7).groupBy("label", "fold").count().collect()
    for c, n in {0: 300, 1: 97, 2: 3}.items():
        sizes = [r["count"] for r in rows if r["label"] == c]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    totals = split.stratified_folds(uneven, 7).groupBy("fold").count().collect()
    assert {r["count"] for r in totals} == {57, 58}


def test_compress_and_guard(uneven):
    assert split.stratified_compress(uneven, 0.5).count() == 200
    guarded = split.stratified_compress_guarded(uneven, 0.001)
    assert split.class_sizes(guarded) == {0: 1, 1: 1, 2: 1}
    with pytest.raises(ValueError):
        split.stratified_compress(uneven, 0.001, strict=True)


def test_split_depends_on_seed_only(uneven):
    one = {r["row_id"] for r in split.stratified_split(uneven, 0.2)[1].collect()}
    two = {r["row_id"] for r in split.stratified_split(uneven.repartition(5), 0.2)[1].collect()}
    other = {r["row_id"] for r in split.stratified_split(uneven, 0.2, seed=1)[1].collect()}
    assert one == two and one != other


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([([v, 1.0],) for v in (1.0, 2.0, 4.0, 9.0)], "features array<double>")
    scaler = FE.fit_scaler(df)
    assert scaler.means[0] == 4.0 and abs(scaler.stds[0] - 3.082207) < 1e-6
    assert scaler.stds[1] == 1.0
    assert {r[0][1] for r in scaler.apply(df).select("features").collect()} == {0.0}


def test_variance_filter_uses_population_variance(spark):
    df = spark.createDataFrame([([v],) for v in (1.0, 2.0, 4.0, 9.0)], "features array<double>")
    assert FE.passing_features(df, 9.4) == [0]
    assert FE.passing_features(df, 9.5) == []


def test_null_policies(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 4.0)], "a double, b double")
    assert FE.assemble(df, ["a", "b"], "skip").count() == 1
    assert [r[0] for r in FE.assemble(df, ["a", "b"], "mean").collect()][1] == [1.0, 4.0]
    with pytest.raises(Exception, match="null feature cell"):
        FE.assemble(df, ["a", "b"]).collect()


def test_class_weight_sums_to_rows(uneven):
    total = uneven.agg(F.sum(FE.class_weight(uneven))).first()[0]
    assert abs(total - 400) < 1e-9


def test_rows_without_time_come_last(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i) for i in range(100)], "row_id bigint, Time bigint")
    for ratio in (0.5, 0.8, 0.9, 0.95, 1.0):
        train, test = split.time_split(df, ratio)
        a, b = [r["row_id"] for r in train.collect()], [r["row_id"] for r in test.collect()]
        assert len(a) == int(100 * ratio) and sorted(a + b) == list(range(100))
        assert ratio > 0.9 or all(i % 10 for i in a)


def test_null_label_is_refused(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "row_id bigint, label int")
    with pytest.raises(ValueError, match="without a label"):
        split.stratified_split(df)

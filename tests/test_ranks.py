"""Order statistics against brute force, with one value or group holding a third of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coreloom.operators import ranks, split


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        value = 5.0 if i % 3 == 0 else math.exp(rng.gauss(0, 3))
        rows.append((i, "hot" if i % 3 else f"g{i % 7}", round(value, 3)))
    return spark.createDataFrame(rows, "row_id bigint, g string, v double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(r["v"])
    return out


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_quantiles_equal_numpy(skewed, bits):
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r for r in ranks.exact_quantiles(skewed, "v", qs, ["g"], bits).collect()}
    for g, values in groups(skewed).items():
        assert got[g]["n"] == len(values)
        assert np.allclose(got[g]["quantiles"], np.percentile(values, [q * 100 for q in qs]))


def test_quantiles_without_groups_and_with_nulls(skewed):
    with_null = skewed.withColumn("v", F.when(F.col("row_id") > 100, F.col("v")))
    values = [r["v"] for r in with_null.collect() if r["v"] is not None]
    got = ranks.exact_quantiles(with_null, "v", [0.01, 0.99]).first()
    assert got["n"] == len(values)
    assert np.allclose(got["quantiles"], np.percentile(values, [1, 99]))


def test_percentile_is_linear(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(1, 8)], "v double")
    assert ranks.exact_quantiles(df, "v", [0.25]).first()["quantiles"] == [6.5]


@pytest.mark.parametrize("bits", [2, 8])
def test_running_totals(skewed, bits):
    rows = ranks.running_totals(skewed, ["g"], "v", {"n": F.lit(1)}, bits).collect()
    for g, values in groups(skewed).items():
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["v"])
        distinct = sorted(set(values))
        assert [r["v"] for r in mine] == distinct
        assert [r["next_value"] for r in mine] == distinct[1:] + [None]
        assert [r["cum_n"] for r in mine] == [sum(v <= d for v in values) for d in distinct]
        assert {r["tot_n"] for r in mine} == {len(values)}


def test_positions_are_dense(skewed):
    unique = skewed.withColumn("o", F.col("v") * 10000 + F.col("row_id") / 3000)
    rows = ranks.with_position(unique, ["g"], "o", bits=4).collect()
    for g in {r["g"] for r in rows}:
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["o"])
        assert [r["idx"] for r in mine] == list(range(len(mine)))


def test_hash_cuts_pick_exact_ranks(skewed):
    import hashlib

    rows = skewed.collect()
    order = {}
    for r in rows:
        order.setdefault(r["g"], []).append(hashlib.md5(f"42:{r['row_id']}".encode()).hexdigest())
    wanted = [(g, k) for g, h in order.items() for k in {1, len(h) // 2, len(h)}]
    table = skewed.sparkSession.createDataFrame(wanted, "g string, rank bigint")
    got = {(r["g"], r["rank"]): r["cut"] for r in ranks.hash_cuts(skewed, ["g"], "row_id", table).collect()}
    assert got == {(g, k): sorted(order[g])[k - 1] for g, k in wanted}


def test_time_split_through_a_tied_time(spark):
    """Two thirds of the rows share the time at the cut."""
    rows = [(i, 0 if i < 10 else (9 if i >= 70 else 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id bigint, Time bigint")
    train, test = split.time_split(df, 0.5)
    assert train.count() == 45 and test.count() == 45
    assert train.where("Time = 0").count() == 10 and train.where("Time = 9").count() == 0
    assert train.intersect(test).count() == 0


def test_time_split_on_timestamps(spark):
    df = spark.sql(
        "SELECT id AS row_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id, 0.25) AS Time FROM range(100)"
    )
    train, test = split.time_split(df, 0.8)
    assert sorted(r["row_id"] for r in train.collect()) == list(range(80))
    assert test.count() == 20


def test_large_groups_get_finer_buckets(skewed, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 10)
    assert ranks._bits_for(3000, 2) == 9 and ranks._bits_for(10**9, 2) == ranks.MAX_BUCKET_BITS
    bucketed = ranks.with_bucket(skewed, ["g"], "v", bits=2)
    assert bucketed.where("g = 'hot'").select("_bucket").distinct().count() > 64
    got = {r["g"]: r for r in ranks.exact_quantiles(skewed, "v", [0.3], ["g"], 2).collect()}
    for g, values in groups(skewed).items():
        assert np.allclose(got[g]["quantiles"], np.percentile(values, [30]))
    whole = ranks.running_totals(skewed, [], "v", {"n": F.lit(1)}, 2)
    assert whole.agg(F.max("cum_n")).first()[0] == 3000


def test_hash_digits_grow_with_the_rows():
    assert ranks.hash_digits(10) == 3
    assert ranks.hash_digits(10**11) == 4


@pytest.fixture
def tiny_buckets(monkeypatch):
    """Limits so small that 3,000 rows need several levels of buckets."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 20)
    monkeypatch.setattr(ranks, "MAX_BUCKET_BITS", 2)


def test_crowded_buckets_are_divided_level_by_level(skewed, tiny_buckets):
    rows = ranks.with_bucket(skewed, ["g"], "v", 1).collect()
    # More than three levels of four buckets each.
    assert max(r["_bucket"] for r in rows) >= 4**3
    by_bucket = {}
    for r in rows:
        by_bucket.setdefault((r["g"], r["_bucket"]), []).append(r["v"])
    # Only copies of one value, and a few rows beside them, may hold more.
    for values in by_bucket.values():
        assert len(values) - max(values.count(v) for v in set(values)) <= 40
    for g in {r["g"] for r in rows}:
        ordered = sorted((b, min(v), max(v)) for (name, b), v in by_bucket.items() if name == g)
        assert all(one[2] < two[1] for one, two in zip(ordered, ordered[1:]))


def test_results_of_nested_buckets(skewed, tiny_buckets):
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r for r in ranks.exact_quantiles(skewed, "v", qs, ["g"], 1).collect()}
    totals = ranks.running_totals(skewed, ["g"], "v", {"n": F.lit(1)}, 1).collect()
    for g, values in groups(skewed).items():
        assert np.allclose(got[g]["quantiles"], np.percentile(values, [q * 100 for q in qs]))
        mine = sorted((r for r in totals if r["g"] == g), key=lambda r: r["v"])
        assert [r["v"] for r in mine] == sorted(set(values))
        assert [r["next_value"] for r in mine] == sorted(set(values))[1:] + [None]
        assert [r["cum_n"] for r in mine] == [sum(v <= r["v"] for v in values) for r in mine]
    whole = [r["v"] for r in skewed.collect()]
    assert np.allclose(ranks.exact_quantiles(skewed, "v", qs, bits=1).first()["quantiles"], np.percentile(whole, [q * 100 for q in qs]))
    places = {r["row_id"]: r["idx"] for r in ranks.with_position(skewed, [], "row_id", bits=1).collect()}
    assert places == {i: i for i in range(3000)}


@pytest.mark.parametrize("position", [1, 1234, 2000, 3000])
def test_position_in_a_crowded_bucket(skewed, tiny_buckets, position):
    values = sorted(r["v"] for r in skewed.collect())
    value, missing, ties = ranks.position_cut(skewed, "v", position, 1)
    want = values[position - 1]
    assert float(value) == want and ties == values.count(want)
    assert missing == position - sum(v < want for v in values)

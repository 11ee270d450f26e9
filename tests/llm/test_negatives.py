"""Hard negatives against a plain computation, and Strassen's products against whole-number ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coreloom.llm import negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (129, 65, 97), (40, 0, 40), (200, 200, 200)])
def test_products_are_exact(shape):
    rng = np.random.default_rng(5)
    n, k, m = shape
    a = rng.integers(-(2**28), 2**28, (n, k))
    b = rng.integers(-(2**28), 2**28, (k, m))
    exact = a.astype(object) @ b.astype(object) if k else np.zeros((n, m))
    assert (negatives.strassen(a, b) == exact).all()


def brute(rows, anchor):
    used = []
    for n, (vec, x, label) in enumerate(rows):
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            used.append((vec, [math.floor(256 * c) for c in x], label, n))
    last = float("inf")

    def first(pairs, k):
        return sorted(pairs, key=lambda p: (-p[0], last if p[1] is None else p[1]))[:k]

    out = []
    for a in used:
        if a[0] is None or not anchor(a[0]):
            continue
        scored = [(sum(p * q for p, q in zip(a[1], b[1])), b[0], b[2] == a[2]) for b in used if b[3] != a[3]]
        for p in first([s for s in scored if s[2]], 5):
            fits = [s for s in scored if not s[2] and 30 * p[0] <= 100 * s[0] <= 90 * p[0]]
            out += [(a[0], p[1], r + 1, s[1], p[0], s[0]) for r, s in enumerate(first(fits, 10))]
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(11)
    rows = [(n, [rng.gauss(0.2, 0.4) for _ in range(5)], n % 3) for n in range(120)]
    rows += [(500 + n, [0.5, 0.25, 0.0, -0.5, 1.0], 1) for n in range(40)]  # ties
    rows += [(10, [0.5] * 5, 1), (10, [0.5] * 5, 1), (20, [0.0] * 5, 2), (30, [], 1), (None, [0.4] * 5, 2), (None, [0.4] * 5, 0)]
    rows += [(40, None, 1), (50, [0.1] * 5, None), (60, [0.1, None, 0.2, 0.3, 0.4], 1), (70, [float("nan")] * 5, 1), (80, [float("inf")] * 5, 1)]
    return rows + [(90, [-0.5, 0.1, 0.1, 0.1, 0.1], 0)]


@pytest.mark.parametrize("block,tile", [(8192, 512), (3, 4)])
def test_against_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = odd_rows()
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    rows = [(v, None if x is None else [None if c is None else float(np.float32(c)) for c in x], y) for v, x, y in rows]
    odd = table.withColumn("_row", F.lit("r")).withColumn("vector", F.lit(1)).withColumn("_anchor", F.lit(None))
    found = negatives.hard_negatives(negatives.prepared(odd), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, lambda v: v % 10 == 0)


def test_empty_and_too_large(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    none = spark.createDataFrame([], schema)
    assert negatives.hard_negatives(negatives.prepared(none), F.col("vec_id") == 0).collect() == []
    huge = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], schema)
    with pytest.raises(ValueError, match="too large"):
        negatives.hard_negatives(negatives.prepared(huge), F.col("vec_id") == 0)


def test_heaps_merge():
    heaps = negatives.Heaps(2, 2)
    one = np.ones((2, 3), dtype=bool)
    heaps.offer(np.array([0, 1]), np.array([[5, 5, 1], [2, 9, 9]]), one, np.array([3, 1, 2]), np.array([0, 1, 2]))
    heaps.settle()
    heaps.offer(np.array([1]), np.array([[9, 8]]), one[:1, :2], np.array([0, 7]), np.array([5, 6]))
    slots, scores, ids, _ = heaps.settle()
    assert list(zip(slots, scores, ids)) == [(0, 5, 1), (0, 5, 3), (1, 9, 0), (1, 9, 1)]

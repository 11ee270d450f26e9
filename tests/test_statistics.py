"""Hand-worked statistics and brute-force comparisons."""

import math
import random

import numpy as np
import pytest

from coreloom.functions import special
from coreloom.functions.scalars import entropy
from coreloom.operators import clusters, metrics, profile, series, similarity
from coreloom.operators.ranks import with_position
from pyspark.sql import functions as F


def column(spark, values):
    return spark.createDataFrame([([float(v)],) for v in values], "features array<double>")


def test_entropy(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],), ([0.25, 0.75],)], "p array<double>")
    got = [r[0] for r in df.select(entropy(F.col("p"))).collect()]
    assert np.allclose(got, [0, 0.693147, 0.562335], atol=1e-6)


def test_ks_and_wasserstein_by_hand(spark):
    row = similarity.distribution_distances(similarity.stack(column(spark, [1, 2, 3]), column(spark, [1, 2, 4]))).first()
    assert abs(row["ks_stat"] - 1 / 3) < 1e-12 and abs(row["wasserstein"] - 1 / 3) < 1e-12


def test_identical_inputs_are_at_distance_zero(spark):
    rng = random.Random(3)
    df = column(spark, [rng.gauss(0, 1) for _ in range(500)])
    row = similarity.similarity_log(similarity.stack(df, df)).first()
    assert row["ks_stat"] == 0 and row["wasserstein"] == 0 and row["js_distance"] == 0 and row["ks_p"] == 1


def test_distances_against_brute_force(spark):
    """A third of the full rows share one value."""
    rng = random.Random(5)
    a = [2.0 if i % 3 == 0 else rng.expovariate(0.5) for i in range(900)]
    b = [rng.expovariate(0.7) for _ in range(60)]
    row = similarity.similarity_log(similarity.stack(column(spark, a), column(spark, b))).first()
    points = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), points, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), points, side="right") / len(b)
    assert abs(row["ks_stat"] - np.abs(fa - fb).max()) < 1e-12
    assert abs(row["wasserstein"] - (np.abs(fa - fb)[:-1] * np.diff(points)).sum()) < 1e-9
    p, edges = np.histogram(a, bins=50, density=True)
    q, _ = np.histogram(b, bins=edges, density=True)
    p, q = (p + 1e-8) / (p + 1e-8).sum(), (q + 1e-8) / (q + 1e-8).sum()
    m = (p + q) / 2
    js = math.sqrt(((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2)
    assert abs(row["js_distance"] - js) < 1e-9


def test_histogram_closes_the_last_bin(spark):
    stacked = similarity.stack(column(spark, range(11)), column(spark, [10, 11, -1]))
    rows = similarity.histograms(stacked, bins=5).orderBy("bin").collect()
    assert [r["full_count"] for r in rows] == [2, 2, 2, 2, 3]
    assert [r["other_count"] for r in rows] == [0, 0, 0, 0, 1]


def test_chi_square_with_and_without_correction(spark):
    def table(rows):
        return spark.createDataFrame(rows, "label int, full_count bigint, other_count bigint")

    two = similarity.chi_square_classes(table([(0, 30, 10), (1, 10, 10)])).first()
    assert two["dof"] == 1 and abs(two["chi2"] - 2.709375) < 1e-9
    three = similarity.chi_square_classes(table([(0, 10, 10), (1, 20, 20), (2, 5, 5)])).first()
    assert three["dof"] == 2 and three["chi2"] == 0 and three["similar"]


def test_missing_class_counts_zero(spark):
    full = spark.createDataFrame([(0,), (0,), (1,)], "label int")
    rows = {r["label"]: (r["full_count"], r["other_count"]) for r in similarity.class_contingency(full, full.where("label = 0")).collect()}
    assert rows == {0: (2, 2), 1: (1, 0)}


def test_zero_padding(spark):
    full = spark.createDataFrame([([1.0, 0.0],), ([2.0, 0.0],)], "features array<double>")
    narrow = spark.createDataFrame([([1.0],)], "features array<double>")
    padded = similarity.pad_missing_with_zeros(similarity.stack(full, narrow))
    rows = {r["feature"]: r for r in similarity.distribution_distances(padded).collect()}
    assert rows[1]["ks_stat"] == 0 and rows[1]["n_other"] == 2


def test_tail_probabilities():
    assert abs(special.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(special.chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(special.student_tail(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(special.student_tail(1.0, 1.0) - 0.5) < 1e-12


def test_kolmogorov_tails_by_hand():
    # Two rows and one: of 3 orders 2 keep the pair together, so D = 1. Two and two: 2 of 6 orders have D = 1, all D >= 1/2.
    assert abs(special.lattice_tail(1.0, 2, 1) - 2 / 3) < 1e-12
    assert abs(special.lattice_tail(1.0, 2, 2) - 2 / 6) < 1e-12
    assert abs(special.lattice_tail(0.5, 2, 2) - 1.0) < 1e-12
    assert abs(special.lattice_tail(1.0, 3, 3) - 2 / 20) < 1e-12
    # D_1 < d has probability 2 d - 1, D_2 < d is 2 (2 d - 1/2) ** 2 up to d = 1/2
    assert abs(special.exact_one_sample(0.7, 1) - 0.4) < 1e-12
    assert abs(special.exact_one_sample(0.4, 2) - 2 * 0.3**2) < 1e-12
    assert abs(special.exact_one_sample(0.274, 10) - 0.6284796) < 1e-6


def test_kolmogorov_tails_against_all_orders():
    from itertools import combinations

    for n, m in ((3, 5), (4, 4), (6, 3)):
        orders = []
        for places in combinations(range(n + m), n):
            i = j = worst = 0
            for at in range(n + m):
                i, j = (i + 1, j) if at in places else (i, j + 1)
                worst = max(worst, abs(i * m - j * n))
            orders.append(worst)
        for d in sorted(set(orders)):
            want = sum(w >= d for w in orders) / len(orders)
            assert abs(special.lattice_tail(d / (n * m), n, m) - want) < 1e-12
            assert abs(special.lattice_tail(d / (n * m), m, n) - want) < 1e-12


def test_kolmogorov_expansion_meets_the_exact_law():
    for n in (140, 300):
        for z in (0.5, 0.8, 1.0, 1.36, 2.0):
            d = z / math.sqrt(n)
            assert abs(special.expanded_one_sample(d, n) - special.exact_one_sample(d, n)) < 0.1 / n**2
    assert abs(special.kolmogorov_tail(1.3580986393225505 / math.sqrt(1e7), 2e7, 2e7) - 0.05) < 1e-4
    assert special.kolmogorov_tail(0.0, 20_000, 20_000) == 1.0 and special.kolmogorov_tail(1.0, 20_000, 20_000) == 0.0
    assert math.isnan(special.kolmogorov_tail(float("nan"), 5, 5))


def test_kde_integrates_to_one(spark):
    rng = random.Random(11)
    long = spark.createDataFrame([("a", 0, rng.gauss(0, 1)) for _ in range(400)], "dataset string, feature int, x double")
    rows = similarity.kde_curves(long).orderBy("point").collect()
    x, d = np.array([r["x"] for r in rows]), np.array([r["density"] for r in rows])
    assert len(rows) == 200 and abs(np.trapezoid(d, x) - 1) < 0.01


def test_leakage(spark):
    core = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), ([1.0, 2.0],)], "features array<double>")
    row = similarity.leakage(core, core.limit(1)).first()
    assert row["overlap"] == 1 and row["leakage"]
    assert not similarity.leakage(core, spark.createDataFrame([([9.0, 9.0],)], "features array<double>")).first()["leakage"]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    assert metrics.accuracy(df).first()[0] == 0.6
    cells = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[(2, 1)] == 1 and cells[(2, 2)] == 0
    report = {r["name"]: r for r in metrics.classification_report(df).collect()}
    assert abs(report["0"]["f1"] - 0.8) < 1e-12 and abs(report["1"]["precision"] - 1 / 3) < 1e-12
    assert report["2"]["recall"] == 0 and report["2"]["precision"] == 0
    assert abs(report["macro avg"]["f1"] - (0.8 + 0.5 + 0) / 3) < 1e-12
    assert abs(report["weighted avg"]["recall"] - 0.6) < 1e-12 and report["accuracy"]["f1"] == 0.6


def test_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, positive int")
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    expected = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(metrics.roc_auc(df, by=()).first()["auc"] - expected) < 1e-12


def test_silhouette_in_several_blocks(spark, vectors):
    rows = vectors.withColumnRenamed("label", "cluster")
    whole = clusters.silhouette(rows).first()[0]
    split_up = clusters.silhouette(rows, block_rows=17).first()[0]
    x = np.array([r["features"] for r in rows.orderBy("row_id").collect()])
    c = np.array([r["cluster"] for r in rows.orderBy("row_id").collect()])
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(x)):
        a = distance[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(distance[i, c == k].mean() for k in set(c) - {c[i]})
        scores.append((b - a) / max(a, b))
    assert abs(whole - np.mean(scores)) < 1e-9 and abs(split_up - whole) < 1e-9


@pytest.mark.parametrize("block_rows", [None, 7])
def test_silhouette_with_overlaps_copies_and_single_rows(spark, block_rows):
    """Overlapping and nested clusters, one with a third of the rows, copies far from the origin, a cluster of one row."""
    rng = random.Random(21)
    rows = [(0, [1e6 + rng.gauss(0, 3), rng.gauss(0, 3)]) for _ in range(60)] + [(1, [1e6 + 1.0, 0.5])] * 9
    rows += [(2 + i % 4, [1e6 + (i % 4) * 2.0 + rng.gauss(0, 1), rng.gauss(0, 0.1)]) for i in range(80)]
    rows += [(6, [1e6 + 40.0, 0.0])] + [(7, [1e6 + 500.0 + rng.random(), 1e-3 * i]) for i in range(20)]
    table = [(i, c, x) for i, (c, x) in enumerate(rows)]
    df = spark.createDataFrame(table + [(-1, None, [0.0, 0.0])], "row_id bigint, cluster int, features array<double>")
    x, c = np.array([r[2] for r in table]), np.array([r[1] for r in table])
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(x)):
        mine = c == c[i]
        a = distance[i, mine].sum() / max(1, mine.sum() - 1)
        b = min(distance[i, c == k].mean() for k in set(c) - {c[i]})
        scores.append((b - a) / max(a, b) if mine.sum() > 1 else 0.0)
    assert abs(clusters.silhouette(df, block_rows=block_rows).first()[0] - np.mean(scores)) < 1e-9


def test_silhouette_and_davies_bouldin_of_too_few(spark):
    none = spark.createDataFrame([], "row_id bigint, cluster int, features array<double>")
    assert clusters.silhouette(none).first()[0] is None and clusters.davies_bouldin(none).first()[0] is None
    one = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], none.schema)
    assert clusters.silhouette(one).first()[0] == 0.0 and clusters.davies_bouldin(one).first()[0] is None


def test_distance_sums_keep_their_digits():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 5)), 1e8 + rng.normal(size=(40, 5)) * 1e-3])
    y = np.concatenate([x[::2], x[::3] + 1e-6])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)).sum(axis=1)
    assert np.allclose(clusters._distance_sums(x, y), want, rtol=1e-9)


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(9)
    rows = [("a" if i % 4 else "b", i, rng.gauss(0, 1) + (i // 4 % 12)) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id string, t bigint, value double")
    return with_position(df, ["series_id"], "t")


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_series_do_not_depend_on_chunks(walk, chunk):
    values = [r["value"] for r in walk.where("series_id = 'a'").orderBy("idx").collect()]
    n = len(values)
    rolled = series.rolling_stats(walk, 5, chunk=chunk).where("series_id = 'a'").orderBy("idx").collect()
    assert len(rolled) == n and rolled[3]["rolling_mean"] is None
    assert all(abs(r["rolling_mean"] - np.mean(values[i - 4 : i + 1])) < 1e-9 for i, r in enumerate(rolled) if i >= 4)
    assert all(abs(r["rolling_std"] - np.std(values[i - 4 : i + 1], ddof=1)) < 1e-9 for i, r in enumerate(rolled) if i >= 4)
    lagged = series.lagged(walk, 3, chunk=chunk).where("series_id = 'a'").orderBy("idx").collect()
    assert [r["lagged"] for r in lagged] == [None] * 3 + values[:-3]
    centered = np.array(values) - np.mean(values)
    table = {r["lag"]: r["acf"] for r in series.acf(walk, 20, chunk=chunk).where("series_id = 'a'").collect()}
    for k in range(21):
        assert abs(table[k] - (centered[: n - k] * centered[k:]).sum() / (centered**2).sum()) < 1e-9
    parts = series.seasonal_decompose(walk, chunk=chunk).where("series_id = 'a'").orderBy("idx").collect()
    assert parts[5]["trend"] is None and parts[n - 6]["trend"] is None
    weights = np.array([0.5] + [1.0] * 11 + [0.5]) / 12
    assert all(abs(parts[i]["trend"] - weights @ values[i - 6 : i + 7]) < 1e-9 for i in range(6, n - 6))
    assert abs(sum({r["phase"]: r["seasonal"] for r in parts}.values())) < 1e-9


def test_pacf_of_a_first_order_process(spark):
    r = [0.6**k for k in range(6)]
    table = spark.createDataFrame([("s", k, v) for k, v in enumerate(r)], "series_id string, lag int, acf double")
    got = [row["pacf"] for row in series.pacf(table).orderBy("lag").collect()]
    assert np.allclose(got, [1, 0.6, 0, 0, 0, 0], atol=1e-12)


def test_pacf_solves_the_yule_walker_equations(spark):
    r = np.array([1.0, 0.7, 0.2, -0.1, 0.05])
    table = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(r)], "series_id string, lag int, acf double")
    got = [row["pacf"] for row in series.pacf(table).orderBy("lag").collect()]
    for k in range(1, 5):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(got[k] - np.linalg.solve(system, r[1 : k + 1])[-1]) < 1e-9


def test_boxplot(spark):
    row = profile.boxplot_stats(column(spark, [1, 2, 3, 4, 5, 100])).first()
    assert (row["q1"], row["median"], row["q3"]) == (2.25, 3.5, 4.75)
    assert row["whisker_low"] == 1 and row["whisker_high"] == 5 and row["outliers"] == 1


def test_kde_feels_far_values(spark):
    import numpy as np

    xs = [float(i % 2) for i in range(99)] + [1000.0]
    df = spark.createDataFrame([("d", 0, x) for x in xs], "dataset string, feature int, x double")
    got = sorted((r["point"], r["x"], r["density"]) for r in similarity.kde_curves(df).collect())
    h = np.std(xs, ddof=1) * len(xs) ** -0.2
    for _, x, density in got:
        want = np.exp(-0.5 * ((x - np.array(xs)) / h) ** 2).sum() / (len(xs) * h * np.sqrt(2 * np.pi))
        assert abs(density - want) <= 1e-12 + 1e-9 * want
    assert all(d > 0 for *_, d in got)


def test_kde_of_boxes_equals_the_sum_of_kernels(spark):
    """Two curves, ties, nulls, a far group of values, and boxes with many values."""
    rng = random.Random(4)
    values = {0: [rng.gauss(0, 1) for _ in range(1500)] + [60.0] * 9, 1: [round(rng.expovariate(1.0), 1) for _ in range(900)]}
    rows = [("d", f, x) for f, xs in values.items() for x in xs] + [("d", 0, None), ("d", 2, 1.0), ("d", 3, 4.0), ("d", 3, 4.0)]
    got = similarity.kde_curves(spark.createDataFrame(rows, "dataset string, feature int, x double"), points=50).collect()
    assert {(r["feature"], r["point"]) for r in got} == {(f, i) for f in (0, 1) for i in range(50)}
    for r in got:
        xs = np.array(values[r["feature"]])
        h = np.std(xs, ddof=1) * len(xs) ** -0.2
        want = np.exp(-0.5 * ((r["x"] - xs) / h) ** 2).sum() / (len(xs) * h * np.sqrt(2 * np.pi))
        assert abs(r["density"] - want) <= 1e-8 * want + 1e-300


def test_means_come_from_the_training_rows(spark):
    from coreloom.operators import features as FE

    train = spark.createDataFrame([(1, [1.0, None]), (2, [None, None]), (3, [3.0, None])], "row_id int, features array<double>")
    test = spark.createDataFrame([(4, [None, 7.0])], "row_id int, features array<double>")
    means = FE.cell_means(train)
    assert FE.fill_cells(train, means).where("row_id = 2").first()["features"] == [2.0, 0.0]
    assert FE.fill_cells(test, means).first()["features"] == [2.0, 7.0]


@pytest.mark.parametrize("band_bytes", [512 << 20, 1])
def test_correlations_of_several_blocks_and_bands(spark, monkeypatch, band_bytes):
    """70 features: three blocks, in one band or in three; a constant feature and a null cell give null."""
    monkeypatch.setattr(profile, "BAND_BYTES", band_bytes)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 70)) @ rng.normal(size=(70, 70)) + 1e5
    x[:, 5] = 3.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[17][1][40] = None
    df = spark.createDataFrame(rows, "row_id int, features array<double>")
    names = [f"f{i}" for i in range(70)]
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df, names).collect()}
    assert len(got) == 70 * 70
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x.T)
    for i in range(70):
        for j in range(70):
            r = got[f"f{i}", f"f{j}"]
            assert r is None if {i, j} & {5, 40} else abs(r - want[i, j]) < 1e-9


def test_correlations_of_two_thousand_features(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 2000))
    x[:, 1999] = -2 * x[:, 0] + 1
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").coalesce(2)
    names = [f"f{i}" for i in range(2000)]
    result = profile.correlation_matrix(df, names)
    some = result.where(F.col("a").isin("f0", "f31", "f32", "f1999")).collect()
    assert result.count() == 2000 * 2000 and len(some) == 4 * 2000
    want = {name: np.corrcoef(x.T, x[:, int(name[1:])])[-1] for name in ("f0", "f31", "f32", "f1999")}
    assert all(abs(r["r"] - want[r["a"]][int(r["b"][1:])]) < 1e-9 for r in some)


def test_correlations_of_an_empty_table(spark):
    none = spark.createDataFrame([], "features array<double>")
    assert [tuple(r) for r in profile.correlation_matrix(none, ["x"]).collect()] == [("x", "x", None)]
    assert profile.correlation_matrix(none, []).count() == 0

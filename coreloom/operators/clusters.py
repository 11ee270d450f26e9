"""Cluster quality and the point-to-centre distances behind it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.functions.scalars import euclidean
from coreloom.operators.bounded import pin_small
from coreloom.operators.features import moments, to_long
from coreloom.operators.select import fit_kmeans

#: Bytes of features in a block of the silhouette, and cells of a tile of distances.
BLOCK_BYTES = 8 * 1024 * 1024
TILE_CELLS = 1 << 19


def class_centers(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, center): the mean feature array of each group."""
    means = to_long(df, F.col(cluster).cast("int").alias("cluster")).groupBy("cluster", "feature").agg(
        F.avg("x").alias("m")
    )
    cells = F.array_sort(F.collect_list(F.struct("feature", "m")))
    return means.groupBy("cluster").agg(F.transform(cells, lambda c: c["m"]).alias("center"))


def _listed(table: DataFrame) -> DataFrame:
    """A table of clusters as one row, ``_all``: an array of its rows, held by the tasks that need every centre."""
    return F.broadcast(pin_small(table).agg(F.collect_list(F.struct("*")).alias("_all")))


def center_distances(df: DataFrame, centers: DataFrame, key: str = "row_id") -> DataFrame:
    """Distance of every row to every centre, as one array per row, then one row per centre.

    The centres of a model travel as one row; neither the plan nor the driver's Python holds them.
    """
    pairs = F.transform(
        "_all",
        lambda c: F.struct(c["cluster"].alias("cluster"), euclidean(F.col("features"), c["center"]).alias("distance")),
    )
    return df.crossJoin(_listed(centers.select("cluster", "center"))).select(key, F.inline(pairs))


def davies_bouldin(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: the Davies-Bouldin index over the groups of ``cluster``."""
    rows = df.withColumn("cluster", F.col(cluster).cast("int"))
    spread = (
        rows.join(pin_small(class_centers(rows)), "cluster")
        .groupBy("cluster")
        .agg(F.avg(euclidean(F.col("features"), F.col("center"))).alias("s"), F.first("center").alias("center"))
    )
    groups = pin_small(spread)
    ratios = F.transform(
        F.filter("_all", lambda o: o["cluster"] != F.col("cluster")),
        lambda o: (F.col("s") + o["s"]) / F.nullif(euclidean(F.col("center"), o["center"]), F.lit(0.0)),
    )
    return groups.crossJoin(_listed(groups)).agg(F.avg(F.array_max(ratios)).alias("davies_bouldin"))


def _facts(rows: DataFrame) -> DataFrame:
    """(c, size, center, spread): rows, mean and mean squared distance from it, per cluster."""
    cells = moments(to_long(rows, "c"), "c")
    listed = F.array_sort(F.collect_list(F.struct("feature", "mean")))
    return cells.groupBy("c").agg(
        F.max("n").alias("size"), F.transform(listed, lambda m: m["mean"]).alias("center"), F.sum("variance").alias("spread")
    )


def _distance_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per row of ``x`` the sum of its Euclidean distances to the rows of ``y``.

    Squared distances come from a matrix product around the mean of ``y``; pairs so close that the subtraction would
    cancel digits (six and more) are computed again from their differences.
    """
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    size_x, size_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
    sums = np.empty(len(x))
    step = max(1, TILE_CELLS // len(y))
    for start in range(0, len(x), step):
        part = x[start : start + step]
        scale = size_x[start : start + step, None] + size_y[None, :]
        squares = scale - 2.0 * (part @ y.T)
        i, j = np.nonzero(squares <= 1e-6 * scale)
        for at in range(0, len(i), step):
            gap = part[i[at : at + step]] - y[j[at : at + step]]
            squares[i[at : at + step], j[at : at + step]] = (gap * gap).sum(axis=1)
        sums[start : start + step] = np.sqrt(squares).sum(axis=1)
    return sums


def silhouette(
    df: DataFrame, cluster: str = "cluster", key: str = "row_id", block_rows: int | None = None
) -> DataFrame:
    """One row: the mean Euclidean silhouette, exact. Rows without a cluster take no part; no cell may be null.

    A row's mean distance to a cluster is at least its distance r to the cluster's mean and at most
    sqrt(r ** 2 + spread), so only clusters whose lower bound is within the row's least upper bound can be the nearest.
    Distances are summed for those and for the row's own cluster alone. Clusters are dealt into blocks of ``block_rows``
    (BLOCK_BYTES by default); a pair of blocks that has a row to compare is one bounded task, which returns a sum
    per row, never a pair of rows. So a row is shipped once for each block of its own and its candidate clusters.
    """
    rows = df.select(F.col(key).alias("k"), F.col(cluster).cast("int").alias("c"), "features").where("c is not null")
    facts = pin_small(_facts(rows))
    if block_rows is None:
        a_block = F.greatest(F.floor(BLOCK_BYTES / (8 * F.greatest(F.size("center"), F.lit(1)))), F.lit(1))
    else:
        a_block = F.lit(block_rows)
    blocks = facts.select("c", F.ceil(F.col("size") / a_block).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(blocks), "c").withColumn("a", F.pmod(F.xxhash64("k"), "blocks").cast("int")).drop("blocks")
    bounds = F.transform(
        "_all",
        lambda o: F.struct(o["c"].alias("other"), o["spread"].alias("spread"), euclidean(F.col("features"), o["center"]).alias("low")),
    )
    others = F.filter("_bounds", lambda o: o["other"] != F.col("c"))
    least = F.array_min(F.transform(others, lambda o: F.sqrt(o["low"] * o["low"] + o["spread"])))
    met = F.filter("_bounds", lambda o: (o["other"] == F.col("c")) | (o["low"] <= F.col("_least") * (1 + 1e-9)))
    wanted = (
        dealt.crossJoin(_listed(facts.select("c", "center", "spread")))
        .withColumn("_bounds", bounds)
        .withColumn("_least", least)
        .select("k", "c", "a", "features", F.explode(F.transform(met, lambda o: o["other"])).alias("other"))
        .join(F.broadcast(blocks.withColumnRenamed("c", "other")), "other")
        .select("k", "c", "a", "features", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    )
    pairs = wanted.select("c", "a", "other", "b").distinct()
    partners = dealt.select(F.col("c").alias("other"), F.col("a").alias("b"), "features").join(pairs, ["other", "b"])
    partners = partners.select(*[F.col(name).alias(name) for name in partners.columns])  # columns apart from those of ``wanted``
    key_type = rows.schema["k"].dataType.simpleString()

    def sums(at: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"k": [], "c": [], "other": [], "total": [], "n": []})
        x, y = (np.asarray(t["features"].to_list(), dtype="float64") for t in (one, two))
        return pd.DataFrame(
            {"k": one["k"], "c": at[0], "other": at[2], "total": _distance_sums(x, y), "n": len(two)}
        )

    group = ["c", "a", "other", "b"]
    partial = (
        wanted.groupBy(*group)
        .cogroup(partners.groupBy(*group))
        .applyInPandas(sums, f"k {key_type}, c int, other int, total double, n bigint")
    )
    per_cluster = partial.groupBy("k", "c", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("c") == F.col("other")
    scored = per_cluster.groupBy("k").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    top = F.greatest("a", "b")
    value = F.when((F.col("size") > 1) & (top > 0), (F.col("b") - F.col("a")) / F.nullif(top, F.lit(0.0)))
    return scored.agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("silhouette"))


def elbow(df: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """(k, inertia): within-cluster sum of squares for each k, on one persisted table."""
    rows = []
    cached = df.persist()
    try:
        for k in ks:
            model, _ = fit_kmeans(cached, k, seed)
            rows.append((k, float(model.summary.trainingCost)))
    finally:
        cached.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def clustering_report(df: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """Cluster the rows into k groups and score the result in linear time.

    The silhouette is the squared-Euclidean one, which needs only sums per cluster;
    :func:`silhouette` has the exact Euclidean form for core-sized tables.
    """
    _, assigned = fit_kmeans(df, k, seed)
    vectors = assigned.select("cluster", array_to_vector("features").alias("_vector"))
    evaluator = ClusteringEvaluator(featuresCol="_vector", predictionCol="cluster")
    found = assigned.select("cluster").distinct().limit(2).count()
    value = float(evaluator.evaluate(vectors)) if found > 1 else None
    scores = df.sparkSession.createDataFrame([("silhouette", value)], "measure string, value double")
    index = davies_bouldin(assigned).select(F.lit("davies_bouldin").alias("measure"), F.col("davies_bouldin").alias("value"))
    return scores.unionByName(index)

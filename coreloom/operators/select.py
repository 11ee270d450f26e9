"""Core-set selection: entropy tails and rows nearest to cluster centres."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreloom.functions.scalars import entropy, euclidean
from coreloom.operators.bounded import held, join_summary, pin_small
from coreloom.operators.cells import depth_below, finished, with_nearest
from coreloom.operators.ranks import exact_quantiles
from coreloom.session import materialize

NESTED_ROUNDS = 5
#: Steps that divide a cell further, and centres that a row meets in one step.
DIVIDING_ROUNDS = 2
FAN = 20
#: Features up to which means are taken feature by feature.
AVERAGED = 128
#: Feature values of a cell (rows times width) up to which one task does what is left to do below it.
TASK_VALUES = 1 << 21


def with_entropy(df: DataFrame, probs: str = "probability") -> DataFrame:
    return df.withColumn("entropy", entropy(F.col(probs)))


def entropy_thresholds(df: DataFrame, low: float = 0.01, high: float = 0.99) -> tuple[float, float]:
    """The two percentile thresholds of the ``entropy`` column, exact."""
    low_value, high_value = exact_quantiles(df, "entropy", [low, high]).first()["quantiles"]
    return low_value, high_value


def entropy_bands(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows of the two entropy tails, tagged ``band``.

    Both comparisons include the threshold; where the thresholds meet, a row belongs
    to both bands and appears twice. One scan feeds both bands.
    """
    low_value, high_value = entropy_thresholds(df, low, high)
    bands = F.array(
        F.when(F.col("entropy") >= high_value, F.lit("high")),
        F.when(F.col("entropy") <= low_value, F.lit("low")),
    )
    return df.withColumn("band", F.explode(F.array_compact(bands)))


def gather(df: DataFrame, selected: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key was selected; a key selected twice gives its row once."""
    return df.join(selected.select(key), key, "left_semi")


def nearest_to_center(assigned: DataFrame, centers: DataFrame, key: str = "row_id") -> DataFrame:
    """Per cluster the row closest to its centre, the smaller key on equal distance.

    ``assigned`` has ``cluster`` and ``features``; ``centers`` is (cluster, center).
    The choice is a ``min_by`` aggregate, so rows are combined before they shuffle;
    a cluster without rows simply has no output.
    """
    rows = assigned.join(pin_small(centers), "cluster")
    return closest(rows.withColumn("distance", euclidean(F.col("features"), F.col("center"))).drop("center"), key)


def closest(rows: DataFrame, key: str = "row_id", twice: bool = False) -> DataFrame:
    """Per ``cluster`` the row of least ``distance``, the smaller key on equal distance.

    ``twice`` reads ``rows`` two times: least distances are numbers, found by hash, and only rows that have them are
    compared whole, which takes a sort. For many rows that are cheap to read.
    """
    whole = F.struct(*[c for c in rows.columns if c != "cluster"])
    near = rows
    if twice:
        unknown = F.count_if(F.col("distance").isNull()) > 0
        least = rows.groupBy(F.col("cluster").alias("_cluster")).agg(F.when(~unknown, F.min("distance")).alias("_least"))
        same = F.col("cluster").eqNullSafe(F.col("_cluster")) & F.col("distance").eqNullSafe(F.col("_least"))
        near = rows.join(least, same, "left_semi")
    picked = near.groupBy("cluster").agg(F.min_by(whole, F.struct("distance", key)).alias("_r"))
    return picked.select("cluster", "_r.*")


def center_table(model: KMeansModel, spark) -> DataFrame:
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def fit_kmeans(
    df: DataFrame, k: int, seed: int = 42, max_iter: int = 20, init: str = "k-means||"
) -> tuple[KMeansModel, DataFrame]:
    """Full-batch Lloyd over the ``features`` arrays; adds the ``cluster`` column."""
    vectors = df.withColumn("_vector", array_to_vector("features"))
    estimator = KMeans(
        k=k, seed=seed, maxIter=max_iter, featuresCol="_vector", predictionCol="cluster", initMode=init
    )
    model = estimator.fit(vectors)
    return model, model.transform(vectors).drop("_vector")


def kmeans_core_set(
    df: DataFrame, k: int, seed: int = 42, key: str = "row_id", method: str = "lloyd"
) -> DataFrame:
    """``cluster, row_id, label, features``: the row nearest to its centre, per non-empty cluster.

    ``method`` is the caller's choice at every size. ``lloyd`` fits one model of ``k``
    centres, which every task holds: ``k`` times the width must fit its memory.
    ``nested`` holds no table of ``k`` centres anywhere (see :func:`nested_clusters`).
    A single cluster is the mean of all rows.
    """
    if k < 2:
        center = df.agg(Summarizer.mean(array_to_vector("features")).alias("_m")).select(
            F.lit(0).alias("cluster"), vector_to_array("_m").alias("center")
        )
        picked = nearest_to_center(df.withColumn("cluster", F.lit(0)), center, key)
    elif method == "lloyd":
        model, assigned = fit_kmeans(df, k, seed)
        picked = nearest_to_center(assigned, center_table(model, df.sparkSession), key)
    elif method == "nested":
        picked = closest(nested_clusters(df, k, seed, key, nearest=True)[0], key, twice=True)
    else:
        raise ValueError(f"unknown method {method}")
    rest = [c for c in picked.columns if c not in ("cluster", "distance")]
    return picked.select(F.col("cluster").cast("bigint").alias("cluster"), *rest)


def nested_clusters(
    df: DataFrame, k: int, seed: int = 42, key: str = "row_id", rounds: int = NESTED_ROUNDS, nearest: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(rows with cluster and distance, centres)`` of about ``k`` clusters, found down a tree of cells; both are written tables.

    Every cell has a quota of clusters. As long as some cell's quota is above FAN, such cells are divided into at most
    FAN cells by a few Lloyd steps, and the quota goes to them by largest remainder, one at least; then every cell is clustered into its quota by
    ``rounds`` steps. A row meets at most FAN centres in a step, whatever ``k`` is and however the rows
    are spread: a cell with a third of them is divided more often, and one of equal rows is one cluster. Equal rows always share a cluster.

    Cells of more than TASK_VALUES values take their steps as Spark jobs, all at once, with means combined before they shuffle. A
    smaller one is shuffled to a single task, which takes the same steps below it in memory (see :mod:`coreloom.operators.cells`), so the rows are
    not read and shuffled anew in every step. It goes there twice, as the last steps start from a seed that counts the levels of the
    whole tree: first features alone, to find the depth, then whole rows. ``nearest`` hands on of a cluster's rows only those of least distance, for :func:`closest`.
    """
    width = df.agg(F.max(F.size("features"))).first()[0] or 0
    most = max(1, TASK_VALUES // max(1, width))
    rows = materialize(df.repartition(key).withColumn("cell", F.lit(0).cast("bigint")), "cells")
    whole = rows.agg(F.count(F.lit(1)).alias("size"), _one_point(width).alias("point"))
    quota = F.when(F.col("point"), 1).otherwise(F.least(F.lit(k), F.col("size")))
    cells = materialize(whole.select(F.lit(0).cast("bigint").alias("cell"), "size", quota.cast("bigint").alias("quota")), "quotas")
    large, crowded = F.col("size") > most, F.col("quota") > FAN
    in_tasks, spread, level = [], [], 0
    while True:
        found = cells.agg(
            F.count_if(~large).alias("small"), F.count_if(large & ~crowded).alias("spread"), F.count_if(large & crowded).alias("divided")
        ).first()
        if found["small"]:
            shares = cells.where(~large).select("cell", F.col("quota").alias("_quota"), F.lit(level).alias("_level"))
            in_tasks.append(join_summary(rows, shares, "cell", key, cells.where(~large)))
        if found["spread"]:
            spread.append((rows, cells.where(large & ~crowded)))
        if not found["divided"]:
            break
        divisible = cells.where(large & crowded)
        # as few levels as FAN allows, each dividing by about the same number
        depth = F.ceil(F.log("quota") / math.log(FAN) - 1e-9)
        parts = F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil(F.pow("quota", 1.0 / depth) - 1e-9)))
        divided, _ = _lloyd(rows, divisible, parts, width, DIVIDING_ROUNDS, seed + level, key)
        rows = materialize(divided.withColumn("cell", _below()).drop("slot", "distance"), "cells")
        cells = materialize(_shared_quotas(rows, divisible, width), "quotas")
        level += 1
    tables = []
    if in_tasks:
        given = reduce(DataFrame.unionByName, in_tasks)
        given = given.withColumn("_hash", F.xxhash64("features")).withColumn("features", F.col("features").cast("array<double>"))
        unknown = given.where(F.col("_quota") > FAN).select("cell", "features", "_hash", "_quota", "_level")
        deepest = depth_below(unknown, width, DIVIDING_ROUNDS, FAN, seed).agg(F.max("depth")).first()[0]
        level = max(level, deepest or 0)
        tables.append(materialize(finished(given, width, DIVIDING_ROUNDS, rounds, FAN, seed, level, nearest), "clusters"))
    cluster = _below().alias("cluster")
    for table, quotas in spread:
        assigned, centers = _lloyd(table, quotas, F.col("quota"), width, rounds, seed + level, key)
        assigned = assigned.withColumn("cluster", _below()).drop("cell", "slot")
        both = assigned.withColumn("center", F.lit(None).cast("array<double>")).withColumn("_mean", F.lit(False))
        means = centers.select(cluster, "center", F.lit(True).alias("_mean"))
        tables.append(materialize(both.unionByName(means, allowMissingColumns=True), "clusters"))
    found = reduce(DataFrame.unionByName, tables)
    return found.where(~F.col("_mean")).drop("center", "_mean"), found.where("_mean").select("cluster", "center")


def _below() -> Column:
    """The number of a cell's part: those of one cell follow each other, and no two cells of any level share one."""
    return F.col("cell") * FAN + F.col("slot") + 1


def _one_point(width: int) -> Column:
    """Whether all rows are equal; feature by feature for a few, as numbers are summed up by hash and arrays by a sort."""
    if not 0 < width <= AVERAGED:
        return F.coalesce(F.min("features") == F.max("features"), F.lit(False))
    equal = F.min(F.size("features")) == F.max(F.size("features"))
    for f in range(width):
        x = F.get("features", F.lit(f))
        alike = (F.min(x) == F.max(x)) & (F.count(x) == F.count(F.lit(1)))
        equal = equal & (F.coalesce(alike, F.lit(False)) | (F.count(x) == 0))
    return F.coalesce(equal, F.lit(False))


def _shared_quotas(rows: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """``cell, size, quota`` of the divided cells: the old cell's quota by largest remainder, one at least."""
    inside = Window.partitionBy("parent")
    new = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), _one_point(width).alias("point"))
    new = new.withColumn("parent", F.floor((F.col("cell") - 1) / FAN))
    old = cells.select(F.col("cell").alias("parent"), F.col("quota").alias("_quota"))
    shared = new.join(old, "parent").withColumn("_extra", F.col("_quota") - F.count(F.lit(1)).over(inside))
    exact = F.col("_extra") * F.col("size") / F.sum("size").over(inside)
    shared = shared.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    shared = shared.withColumn("_left", F.col("_extra") - F.sum("_base").over(inside))
    place = F.row_number().over(inside.orderBy(F.desc(F.col("_exact") - F.col("_base")), "cell"))
    quota = 1 + F.col("_base") + F.when(place <= F.col("_left"), 1).otherwise(0)
    quota = F.when(F.col("point"), 1).otherwise(F.least(quota, F.col("size")))
    return shared.select("cell", "size", quota.cast("bigint").alias("quota"))


def _lloyd(
    rows: DataFrame, cells: DataFrame, parts: Column, width: int, rounds: int, seed: int, key: str
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``slot`` and ``distance``, and the centres (cell, slot, center), after ``rounds`` steps inside every cell.

    ``parts`` says, over the columns of ``cells``, into how many slots a cell goes. Slots start at the rows of lowest hash among
    those that a hash of the features deals to them.
    """
    shares = cells.select("cell", parts.cast("bigint").alias("_parts"))
    dealt = join_summary(rows, shares, "cell", key, cells)
    slot = F.pmod(F.xxhash64("features", F.lit(seed)), F.col("_parts")).cast("int")
    order = F.xxhash64("features", F.lit(seed + 1))
    dealt = dealt.select("cell", slot.alias("slot"), order.alias("_order"), "features")
    lowest = dealt.groupBy("cell", "slot").agg(F.min("_order").alias("_order"))
    first = dealt.join(lowest, ["cell", "slot", "_order"], "left_semi")
    centers = first.groupBy("cell", "slot").agg(F.min_by("features", "_order").alias("center"))

    def assign(columns: list[str], centers: DataFrame, summed: bool = False) -> DataFrame:
        """Every row with its nearest centre or, if ``summed``, the rows' sums. Tasks hold the centres if they are few by a checked size, else rows bring them."""
        centers, table = held(centers.select("cell", "slot", "center"))
        near = F.array_sort(F.collect_list(F.struct("slot", "center"))).alias("_near")  # at most FAN
        listed = shares.select("cell") if table is not None else centers.groupBy("cell").agg(near)
        return with_nearest(join_summary(rows.select(*columns), listed, "cell", key, cells), table, width, FAN, summed)

    for _ in range(rounds):
        if width <= AVERAGED:
            near = assign([key, "cell", "features"], centers, summed=True).groupBy("cell", "slot")
            sums = [(F.sum(F.get("sums", F.lit(f))), F.sum(F.get("known", F.lit(f)))) for f in range(width)]
            means = near.agg(*[F.try_divide(total, known).alias(f"_m{f}") for f, (total, known) in enumerate(sums)])
            center = F.array(*[F.col(f"_m{f}") for f in range(width)])
        else:
            near = assign([key, "cell", "features"], centers).groupBy("cell", "slot")
            means = near.agg(Summarizer.mean(array_to_vector("features")).alias("_m"))
            center = vector_to_array("_m")
        centers = means.select("cell", "slot", center.alias("center"))
    centers = materialize(centers, "centers")
    return assign(rows.columns, centers), centers

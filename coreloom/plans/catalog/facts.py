"""What SQL can state about fitted models: row counts, bounds and identities that hold for any fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from coreloom.functions.scalars import euclidean
from coreloom.operators import features as FE
from coreloom.operators import models as M
from coreloom.operators import reduce, select
from coreloom.operators.bounded import join_summary
from coreloom.plans import standins as S
from coreloom.plans.catalog.models import parts
from coreloom.plans.catalog.registry import query
from coreloom.session import materialize

#: Rows of the stratified split: a fifth, rounded up, is for tests.
SPLIT = """s AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS held FROM embeddings)"""


@query(
    "kmeans_core_set_facts",
    f"""WITH {SPLIT} SELECT n - held AS train_rows, greatest(1, (n - held) // 100) AS wanted, true AS one_row_each,
    true AS within_wanted, true AS rows_of_the_table, true AS nearest FROM s""",
)
def kmeans_core_set_facts(spark, sf):
    """One row per cluster, at most k of them, each of them the row nearest to its centre."""
    train, _ = parts(spark, sf)
    n = train.count()
    k = max(1, n // 100)
    core = materialize(select.kmeans_core_set(train, k), "core")
    model, assigned = select.fit_kmeans(train, k)
    if k < 2:
        nearest = core.select(F.lit(True).alias("nearest"))
    else:
        best = select.nearest_to_center(assigned, select.center_table(model, spark)).select(
            F.col("cluster").cast("bigint").alias("cluster"), F.col("row_id").alias("best")
        )
        nearest = core.join(best, "cluster", "full").agg(F.every(F.col("row_id").eqNullSafe(F.col("best"))).alias("nearest"))
    counts = core.agg(
        F.count(F.lit(1)).alias("c"), F.count_distinct("cluster").alias("k"), F.count_distinct("row_id").alias("r")
    )
    known = core.join(train.select("row_id"), "row_id", "left_semi").agg(F.count(F.lit(1)).alias("known"))
    return counts.crossJoin(known).crossJoin(nearest).select(
        F.lit(n).cast("bigint").alias("train_rows"),
        F.lit(k).cast("bigint").alias("wanted"),
        ((F.col("c") == F.col("k")) & (F.col("c") == F.col("r"))).alias("one_row_each"),
        (F.col("c") <= k).alias("within_wanted"),
        (F.col("known") == F.col("c")).alias("rows_of_the_table"),
        "nearest",
    )


@query(
    "kmeans_core_set_cells_facts",
    """SELECT count(*) AS rows, greatest(1, count(*) // 500) AS wanted, true AS within_wanted, true AS one_row_each,
    true AS every_row_once, true AS nearest_centre_of_its_cell, true AS distances_fit, true AS picks_are_nearest FROM lineitem""",
)
def kmeans_core_set_cells_facts(spark, sf):
    """Nested clusters of the line items: each row is with a centre of its cell that no other one of the cell beats, each pick nearest to its centre."""
    lines = S.wide_features(spark, sf)
    scaled = materialize(FE.fit_scaler(lines).apply(lines).withColumn("row_id", F.monotonically_increasing_id()), "lines")
    n = scaled.count()
    k = max(1, n // 500)
    assigned, centers = select.nested_clusters(scaled, k)
    assigned = assigned.select("row_id", "features", "cluster", "distance")
    cell = F.floor((F.col("cluster") - 1) / select.FAN).alias("cell")
    others = centers.groupBy(cell).agg(F.collect_list(F.struct(F.col("cluster").alias("other"), F.col("center").alias("x"))).alias("_others"))
    inside = assigned.withColumn("cell", cell)
    sizes = inside.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    met = join_summary(inside, others, "cell", "row_id", sizes).select(
        "cluster", "distance", F.transform("_others", lambda o: F.struct(o["other"], euclidean(F.col("features"), o["x"]).alias("d"))).alias("_met")
    )
    met = met.select(
        "distance",
        F.array_min(F.transform("_met", lambda m: m["d"])).alias("least"),
        F.get(F.filter("_met", lambda m: m["other"] == F.col("cluster")), F.lit(0))["d"].alias("own"),
    )
    rows = met.agg(
        F.count(F.lit(1)).alias("met"),
        F.every(F.col("own") <= F.col("least") + 1e-9).alias("nearest_centre_of_its_cell"),
        F.every(F.abs(F.col("own") - F.col("distance")) < 1e-9).alias("distances_fit"),
    )
    picks = select.closest(assigned, twice=True)
    least = assigned.groupBy("cluster").agg(F.min("distance").alias("_least"))
    picked = picks.join(least, "cluster", "full").agg(
        F.count(F.lit(1)).alias("picks"),
        F.count_distinct("row_id").alias("ids"),
        F.every(F.coalesce(F.col("distance") == F.col("_least"), F.lit(False))).alias("picks_are_nearest"),
    )
    counts = assigned.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("different"))
    return counts.crossJoin(rows).crossJoin(picked).select(
        "rows",
        F.lit(k).cast("bigint").alias("wanted"),
        (F.col("picks") <= k).alias("within_wanted"),
        (F.col("picks") == F.col("ids")).alias("one_row_each"),
        ((F.col("rows") == n) & (F.col("different") == n) & (F.col("met") == n)).alias("every_row_once"),
        "nearest_centre_of_its_cell",
        "distances_fit",
        "picks_are_nearest",
    )


@query(
    "kmeans_fit_facts",
    "SELECT count(*) AS rows, true AS every_row_once, true AS known_clusters FROM embeddings",
)
def kmeans_fit_facts(spark, sf):
    _, assigned = select.fit_kmeans(S.features(spark, sf), 10)
    return assigned.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_distinct("row_id") == F.count(F.lit(1))).alias("every_row_once"),
        F.every(F.col("cluster").between(0, 9)).alias("known_clusters"),
    )


@query("forest_predict_facts", f"WITH {SPLIT} SELECT held AS rows, true AS shares_sum_to_one, true AS largest_share_wins FROM s")
def forest_predict_facts(spark, sf):
    train, test = parts(spark, sf)
    scored = M.predict(M.fit_forest(train, M.CORE_ANOMALY_KMEANS.with_trees(20)), test)
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.every(F.abs(total - 1) < 1e-9).alias("shares_sum_to_one"),
        F.every(F.get("probability", F.col("prediction").cast("int")) == F.array_max("probability")).alias("largest_share_wins"),
    )


@query("feature_importance_facts", "SELECT CAST(64 AS BIGINT) AS features, CAST(1.0 AS DOUBLE) AS total, true AS none_negative")
def feature_importance_facts(spark, sf):
    train, _ = parts(spark, sf)
    table = M.importances(M.fit_forest(train, M.CORE_ANOMALY_KMEANS.with_trees(20)), S.EMBEDDING_NAMES, spark)
    return table.agg(
        F.count_distinct("feature").alias("features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.every(F.col("importance") >= 0).alias("none_negative"),
    )


@query(
    "pca_facts",
    """SELECT CAST(64 AS BIGINT) AS components, CAST(1.0 AS DOUBLE) AS total, true AS reached_at_needed,
    true AS not_before, true AS scores_have_mean_zero""",
)
def pca_facts(spark, sf):
    rows = S.features(spark, sf)
    fitted = reduce.fit_pca(rows)
    variances = fitted.variance_table(spark).agg(
        F.count(F.lit(1)).alias("components"),
        F.round(F.sum("explained"), 6).alias("total"),
        F.every((F.col("component") != fitted.k) | (F.col("cumulative") >= 0.95)).alias("reached_at_needed"),
        F.every((F.col("component") >= fitted.k) | (F.col("cumulative") < 0.95)).alias("not_before"),
    )
    scores = fitted.transform(rows).select(F.posexplode("features").alias("component", "x"))
    means = scores.groupBy("component").agg(F.avg("x").alias("m"))
    return variances.crossJoin(means.agg(F.every(F.abs(F.col("m")) < 1e-6).alias("scores_have_mean_zero")))


@query(
    "entropy_core_set_facts",
    f"WITH {SPLIT} SELECT n - held AS train_rows, true AS both_tails, true AS high_above_low FROM s",
)
def entropy_core_set_facts(spark, sf):
    """Each tail holds at least a hundredth of the rows, and the high one starts where the low one may end."""
    train, _ = parts(spark, sf)
    n = train.count()
    model = M.fit_forest(train, M.FULL_ANOMALY_ENTROPY_PCA.with_trees(20))
    scored = materialize(select.with_entropy(M.predict(model, train)).select("row_id", "entropy"), "entropy")
    bands = select.entropy_bands(scored)
    high, low = F.col("band") == "high", F.col("band") == "low"
    return bands.agg(
        F.lit(n).cast("bigint").alias("train_rows"),
        ((F.count_if(high) >= n // 100) & (F.count_if(low) >= n // 100)).alias("both_tails"),
        (F.min(F.when(high, F.col("entropy"))) >= F.max(F.when(low, F.col("entropy")))).alias("high_above_low"),
    )

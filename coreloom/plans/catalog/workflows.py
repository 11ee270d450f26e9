"""The eight workflows end to end, and the reports over one of them."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import functions as F

from coreloom.operators import features as FE
from coreloom.operators import shape
from coreloom.plans import standins as S
from coreloom.plans import workflow
from coreloom.plans.catalog import sql as Q
from coreloom.plans.catalog.registry import query
from coreloom.session import materialize, scratch_root
from coreloom.sources.stages import Stages


def sensor_features(spark, sf):
    """(row_id, Time, features, label) from the raw sensor and response series."""
    table = shape.feature_table(S.sensor_long(spark, sf), S.responses(spark, sf), S.EVENT_CODES, S.NODES, Q.CELLS)
    table = materialize(table, "feature_table")
    rows = FE.assemble(table.where("Value is not null"), Q.CELLS, "keep")
    return rows.select(F.col("Time").cast("string").alias("row_id"), "Time", "features", F.col("Value").alias("label"))


ORDER_NAMES = ["o_totalprice", "o_custkey", "day", "weekday"]


def order_features(spark, sf):
    """(row_id, Time, features, label) from the orders; the label is the price's band, so a forest can learn it."""
    price = F.col("o_totalprice")
    label = F.when(price < 150_000, 0).when(price < 300_000, 1).otherwise(2)
    cells = ["o_totalprice", "o_custkey", F.dayofyear("o_orderdate"), F.dayofweek("o_orderdate")]
    return S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias("Time"),
        F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in cells]).alias("features"),
        label.alias("label"),
    )


def stage_store(spark):
    """Where the workflows keep their stages: the same for all runs that share a scratch folder."""
    return Stages(spark, f"{scratch_root(spark)}/coreloom/stages")


def execute(name, spark, sf):
    """Plans that keep a fiftieth of the core set read the orders, whose core is large enough; other anomaly plans the embeddings, application plans the sensors."""
    plan, store = workflow.PLANS[name], stage_store(spark)
    if plan.compress == "stratified" and not plan.guarded:
        return workflow.run(order_features(spark, sf), plan, ORDER_NAMES, store=store)
    if plan.split == "time":
        return workflow.run(sensor_features(spark, sf), replace(plan, impute=True), Q.CELLS, store=store)
    return workflow.run(S.features(spark, sf), plan, S.EMBEDDING_NAMES, store=store)


def _summary(name, spark, sf):
    return execute(name, spark, sf).summary()


for _name in workflow.PLANS:
    query(f"workflow_{_name}")(partial(_summary, _name))


@query("compare_models")
def compare_models(spark, sf):
    return execute("anomaly_kmeans_stratified", spark, sf).report()


@query("summary_table")
def summary_table(spark, sf):
    return execute("anomaly_kmeans_pca", spark, sf).summary()


@query(
    "run_evaluation",
    """WITH s AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS held FROM embeddings)
    SELECT n - held AS full_rows, CAST(10 AS BIGINT) AS curves, true AS curves_start_at_zero,
    CAST(0 AS BIGINT) AS leaked_rows, true AS shares_sum_to_one FROM s""",
)
def run_evaluation(spark, sf):
    """A finished run's ROC curves (one per label), leakage, core report and component importances, as facts SQL can state."""
    run = execute("anomaly_kmeans_pca", spark, sf)
    curves = run.roc().where("model = 'full'").groupBy("class").agg(
        F.count_if(F.col("threshold").isNull() & (F.col("fpr") == 0) & (F.col("tpr") == 0)).alias("starts")
    )
    curves = curves.agg(F.count(F.lit(1)).alias("curves"), F.every(F.col("starts") == 1).alias("curves_start_at_zero"))
    full = run.core_report().agg(F.sum("full_rows").cast("bigint").alias("full_rows"))
    shares = run.component_importances().agg((F.abs(F.sum("importance") - 1) < 1e-6).alias("shares_sum_to_one"))
    leaked = run.leakage().select(F.col("overlap").alias("leaked_rows"))
    return full.crossJoin(curves).crossJoin(leaked).crossJoin(shares)


@query("top_feature_similarity_log")
def top_feature_similarity_log(spark, sf):
    """The similarity log restricted to the features the full forest ranks highest."""
    return execute("application_kmeans_stratified", spark, sf).similarity_log(50)


def _split_sql(split):
    held = "CAST(ceil(0.2 * count(*)) AS BIGINT)"
    kept = f"count(*) - {held}" if split == "stratified" else "CAST(floor(0.8 * count(*)) AS BIGINT)"
    return f"""SELECT {kept} AS train_rows, count(*) - ({kept}) AS test_rows, true AS both_tails, true AS a_fiftieth,
    true AS quotas_in_proportion, true AS rows_of_the_core, CAST(3 AS BIGINT) AS models, true AS every_test_row_scored FROM orders"""


def _sampled_facts(name, spark, sf):
    """A run that keeps a fiftieth of its core: rows per table, and each class's quota within one row of its share."""
    run = execute(name, spark, sf)
    train, test = run.train.count(), run.test.count()
    core = run.core.groupBy("label").agg(F.count(F.lit(1)).alias("core_rows"))
    small = run.compressed.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    both = core.join(small, "label", "left").select("core_rows", F.coalesce("rows", F.lit(0)).alias("rows"))
    total, kept = F.sum("core_rows"), F.sum("rows")
    sizes = both.agg(total.alias("core"), kept.alias("kept"))
    near = both.crossJoin(F.broadcast(sizes)).agg(
        F.every(F.abs(F.col("rows") - F.col("core_rows") * F.col("kept") / F.col("core")) < 1).alias("quotas_in_proportion")
    )
    tails = run.core.agg(
        (F.count_if(F.col("row_id").endswith("#high")) >= train // 100).alias("high"),
        (F.count_if(F.col("row_id").endswith("#low")) >= train // 100).alias("low"),
    )
    strangers = run.compressed.join(run.core, "row_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("rows_of_the_core"))
    scored = run.predictions.groupBy("model").agg((F.count(F.lit(1)) == test).alias("whole"))
    scored = scored.agg(F.count(F.lit(1)).alias("models"), F.every("whole").alias("every_test_row_scored"))
    return near.crossJoin(sizes).crossJoin(tails).crossJoin(strangers).crossJoin(scored).select(
        F.lit(train).cast("bigint").alias("train_rows"),
        F.lit(test).cast("bigint").alias("test_rows"),
        (F.col("high") & F.col("low")).alias("both_tails"),
        (F.col("kept") == F.floor(F.col("core") / 50)).alias("a_fiftieth"),
        "quotas_in_proportion",
        "rows_of_the_core",
        "models",
        "every_test_row_scored",
    )


for _name in ("anomaly_entropy_stratified", "application_entropy_stratified"):
    query(f"workflow_{_name}_facts", _split_sql(workflow.PLANS[_name].split))(partial(_sampled_facts, _name))

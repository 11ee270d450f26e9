"""Classification metrics of a fixed prediction rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from coreloom.operators import metrics as ME
from coreloom.plans import standins as S
from coreloom.plans.catalog import sql as Q
from coreloom.plans.catalog.registry import query
from coreloom.plans.catalog.tables import rounded


@query(
    "confusion_matrix",
    f"""WITH {Q.PREDICTIONS}, c AS (SELECT DISTINCT label AS k FROM predictions UNION SELECT DISTINCT prediction FROM predictions)
    SELECT a.k AS label, b.k AS prediction, count(p.row_id) AS n
    FROM c a CROSS JOIN c b LEFT JOIN predictions p ON p.label = a.k AND p.prediction = b.k GROUP BY a.k, b.k""",
)
def confusion_matrix(spark, sf):
    return ME.confusion_matrix(S.predictions(spark, sf))


PER_CLASS = f"""{Q.PREDICTIONS},
k AS (SELECT DISTINCT label AS class FROM predictions UNION SELECT DISTINCT prediction FROM predictions),
per AS (SELECT class, CAST((SELECT count(*) FROM predictions WHERE label = class AND prediction = class) AS DOUBLE) AS tp,
               (SELECT count(*) FROM predictions WHERE prediction = class) AS predicted,
               (SELECT count(*) FROM predictions WHERE label = class) AS support FROM k),
scored AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
                  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
                  CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1 FROM per)"""


@query(
    "classification_report",
    f"""WITH {PER_CLASS}
    SELECT CAST(class AS VARCHAR) AS name, {Q.r('precision')} AS precision, {Q.r('recall')} AS recall, {Q.r('f1')} AS f1, support FROM scored
    UNION ALL SELECT 'accuracy', NULL, NULL, {Q.r('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM scored
    UNION ALL SELECT 'macro avg', {Q.r('avg(precision)')}, {Q.r('avg(recall)')}, {Q.r('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM scored
    UNION ALL SELECT 'weighted avg', {Q.r('sum(precision * support) / sum(support)')}, {Q.r('sum(recall * support) / sum(support)')},
      {Q.r('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM scored""",
)
def classification_report(spark, sf):
    return rounded(ME.classification_report(S.predictions(spark, sf)), ["precision", "recall", "f1"])


@query(
    "accuracy",
    f"WITH {Q.PREDICTIONS} SELECT {Q.r('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM predictions",
)
def accuracy(spark, sf):
    return rounded(ME.accuracy(S.predictions(spark, sf)), ["accuracy"])


@query(
    "weighted_prf",
    f"""WITH {PER_CLASS} SELECT {Q.r('sum(tp) / sum(support)')} AS accuracy,
    {Q.r('sum(precision * support) / sum(support)')} AS precision, {Q.r('sum(recall * support) / sum(support)')} AS recall,
    {Q.r('sum(f1 * support) / sum(support)')} AS f1 FROM scored""",
)
def weighted_prf(spark, sf):
    return rounded(ME.scores(S.predictions(spark, sf)), ["accuracy", "precision", "recall", "f1"])


# One-vs-rest scores without a model: user shares of each event type against the most frequent type.
OVR = f"""{Q.PROBS},
ovr AS ({' UNION ALL '.join(f"SELECT {i} AS class, p{i} AS score, CAST(label = {i} AS INTEGER) AS positive FROM entropies" for i in range(5))}),
d AS (SELECT class, score, sum(positive) AS p, sum(1 - positive) AS q FROM ovr GROUP BY class, score),
c AS (SELECT class, score, p, q, sum(p) OVER above AS tp, sum(q) OVER above AS fp,
             sum(q) OVER (PARTITION BY class ORDER BY score) - q AS below,
             CAST(sum(p) OVER (PARTITION BY class) AS DOUBLE) AS np, CAST(sum(q) OVER (PARTITION BY class) AS DOUBLE) AS nq
      FROM d WINDOW above AS (PARTITION BY class ORDER BY score DESC))"""


def _ovr(spark, sf):
    return ME.one_vs_rest(S.probs(spark, sf))


@query(
    "roc_curve",
    f"""WITH {OVR} SELECT class, {Q.r('score')} AS threshold, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp,
    {Q.r('fp / nq')} AS fpr, {Q.r('tp / np')} AS tpr FROM c
    UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
      CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c""",
)
def roc_curve(spark, sf):
    return rounded(ME.roc_curve(_ovr(spark, sf)), ["threshold", "fpr", "tpr"])


@query("roc_auc_ovr", f"WITH {OVR} SELECT class, {Q.r('sum(p * (below + q / 2.0)) / max(np * nq)')} AS auc FROM c GROUP BY class")
def roc_auc_ovr(spark, sf):
    return rounded(ME.roc_auc(_ovr(spark, sf)), ["auc"])


@query(
    "roc_curve_binary",
    f"""WITH {Q.PREDICTIONS}, d AS (SELECT score, sum(CAST(label = 1 AS INTEGER)) AS p, sum(CAST(label <> 1 AS INTEGER)) AS q
      FROM predictions GROUP BY score),
    c AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, CAST(sum(p) OVER () AS DOUBLE) AS np,
                 CAST(sum(q) OVER () AS DOUBLE) AS nq FROM d WINDOW w AS (ORDER BY score DESC))
    SELECT score AS threshold, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp, {Q.r('fp / nq')} AS fpr, {Q.r('tp / np')} AS tpr FROM c
    UNION ALL SELECT NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""",
)
def roc_curve_binary(spark, sf):
    rows = S.predictions(spark, sf).select("score", (F.col("label") == 1).cast("int").alias("positive"))
    return rounded(ME.roc_curve(rows, by=()), ["fpr", "tpr"])

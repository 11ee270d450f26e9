"""Classification metrics from (label, prediction) and class probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.functions.scalars import safe_ratio
from coreloom.operators.bounded import small_rows
from coreloom.operators.ranks import running_totals


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """(by, label, prediction, n): at most classes squared rows per group."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Dense matrix in long form over every class that occurs on either side."""
    pairs = small_rows(pair_counts(df, label, prediction), 1_000_000, "label pairs")
    seen = {(r["label"], r["prediction"]): r["n"] for r in pairs}
    classes = sorted({c for pair in seen for c in pair})
    rows = [(a, p, seen.get((a, p), 0)) for a in classes for p in classes]
    return df.sparkSession.createDataFrame(rows, "label int, prediction int, n bigint")


def class_scores(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Per class: true positives, predicted, support, precision, recall, F1."""
    pairs = pair_counts(df, label, prediction, by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"), hit.cast("bigint").alias("tp"), zero.alias("predicted"), F.col("n").alias("support")
        ),
        F.struct(F.col("prediction").alias("class"), zero.alias("tp"), F.col("n").alias("predicted"), zero.alias("support")),
    )
    per_class = (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    )
    return (
        per_class.withColumn("precision", safe_ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", safe_ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", safe_ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Class rows plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows.

    Every class row also feeds the three summary rows, each with its own weight, so
    one aggregate over a table of classes yields the whole report. The accuracy row
    has its value under ``f1`` only.
    """
    per_class = class_scores(df, label, prediction, by)

    def line(name, weight):
        return F.struct(
            name.alias("name"),
            weight.cast("double").alias("w"),
            "precision",
            "recall",
            "f1",
            "support",
        )

    lines = F.array(
        line(F.col("class").cast("string"), F.lit(1)),
        line(F.lit("accuracy"), F.col("support")),
        line(F.lit("macro avg"), F.lit(1)),
        line(F.lit("weighted avg"), F.col("support")),
    )
    rows = per_class.select(*by, F.inline(lines)).groupBy(*by, "name")

    def mean(c):
        return F.sum(F.col("w") * F.col(c)) / F.nullif(F.sum("w"), F.lit(0.0))

    report = rows.agg(
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean("f1").alias("f1"),
        F.sum("support").alias("support"),
    )
    accuracy = F.col("name") == "accuracy"
    return report.select(
        *by,
        "name",
        F.when(~accuracy, F.col("precision")).alias("precision"),
        F.when(~accuracy, F.col("recall")).alias("recall"),
        F.when(accuracy, F.col("recall")).otherwise(F.col("f1")).alias("f1"),
        "support",
    )


def scores(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, one row per group."""
    per_class = class_scores(df, label, prediction, by)
    total = F.sum("support")

    def weighted(c):
        return (F.sum(F.col(c) * F.col("support")) / total).alias(c)

    return per_class.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1")
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def one_vs_rest(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """(class, score, positive 0/1): one row per class probability."""
    return df.select(label, F.posexplode(probability).alias("class", "score")).select(
        "class", "score", (F.col(label) == F.col("class")).cast("int").alias("positive")
    )


def roc_curve(df: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """ROC points at every distinct score, from (by, score, positive).

    A point counts the rows scoring at or above the threshold. Each curve starts at
    (0, 0), whose threshold is null.
    """
    positive = F.col("positive").cast("bigint")
    totals = running_totals(df, by, "score", {"p": positive, "q": 1 - positive})
    tp = F.col("tot_p") - F.col("cum_p") + F.col("p")
    fp = F.col("tot_q") - F.col("cum_q") + F.col("q")
    point = F.struct(
        F.col("score").alias("threshold"),
        fp.alias("fp"),
        tp.alias("tp"),
        safe_ratio(fp, F.col("tot_q")).alias("fpr"),
        safe_ratio(tp, F.col("tot_p")).alias("tpr"),
    )
    # The largest score's row also gives the start point.
    last = F.col("next_value").isNull()
    none = {"threshold": F.lit(None), "fp": F.lit(0), "tp": F.lit(0), "fpr": F.lit(0.0), "tpr": F.lit(0.0)}
    types = totals.select(point.alias("p")).schema["p"].dataType.fields
    start = F.struct(*[none[f.name].cast(f.dataType).alias(f.name) for f in types])
    points = totals.select(*by, F.explode(F.when(last, F.array(point, start)).otherwise(F.array(point))).alias("_p"))
    return points.select(*by, "_p.*")


def roc_auc(df: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """Area under the curve; ties count half (the rank-sum form)."""
    positive = F.col("positive").cast("bigint")
    totals = running_totals(df, by, "score", {"p": positive, "q": 1 - positive})
    won = F.col("p") * (F.col("cum_q") - F.col("q") / 2.0)
    pairs = F.max(F.col("tot_p").cast("double") * F.col("tot_q"))
    return totals.groupBy(*by).agg((F.sum(won) / F.nullif(pairs, F.lit(0.0))).alias("auc"))

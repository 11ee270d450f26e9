"""Quality rules whose cutoffs limit how many good documents they reject.

Labelled documents are divided by a hash of their id. On one half, each metric's
quantiles among good documents of a stratum (a language) give nested *levels* of
cutoffs, from lax (only beyond every good document) to strict. On the other half, the
holdout, a level's false rejections k among n good documents are tested against the
hypothesis "this level rejects more than ``ALPHA`` of the stratum's good documents" with the
exact binomial tail. Levels are tested from lax to strict and testing stops at the
first one that fails; over the strata the error rate ``DELTA`` is divided by their number. So
with probability 1 - DELTA no stratum's rules reject more than ALPHA of its good
documents. Among the certified levels the one that separates the first half best is used; a stratum
with too few labels has no certified level and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreloom.llm import text
from coreloom.llm.names import unused
from coreloom.llm.registry import query, table
from coreloom.operators.bounded import pin_small
from coreloom.session import materialize

#: A stratum's good documents may be rejected up to this share, with this chance of error over all strata.
ALPHA = 0.02
DELTA = 0.05
#: Shares of good documents beyond a metric's cutoff, from lax to strict.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02)
#: Metrics where a large value is bad; mean word length counts in both directions.
METRICS = ("symbols", "dup_lines", "repeats", "capitals", "shouts", "long_words", "short_words")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_positions(words: Column) -> Column:
    """(hash, position) of every 3-word window, sorted; equal windows are neighbours."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )
    return F.sort_array(F.when(n >= 3, windows).otherwise(F.filter(windows, lambda _: F.lit(False))))


def _repeated(sorted_windows: Column) -> Column:
    """Positions of windows that occur again in the text, ascending."""
    again = F.filter(
        sorted_windows,
        lambda w, k: (F.get(sorted_windows, k - 1)["h"] == w["h"]) | (F.get(sorted_windows, k + 1)["h"] == w["h"]),
    )
    return F.sort_array(F.transform(again, lambda w: w["i"]))


def _covered(positions: Column) -> Column:
    """Words in windows that start at ``positions``: each window adds what the next does not cover."""
    gaps = F.transform(
        positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3)))
    )
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts of ``BASE``, ``base_failed`` and the ratios of ``METRICS``; no shuffle.

    Null texts count as empty: no words, base failed. Input columns of these names are
    replaced. Windows are compared by 64-bit hash within one text.
    """
    new = {*BASE, *METRICS, "base_failed"}
    given = [c for c in docs.columns if c not in new]
    # inner names begin with an underscore; the caller's columns go by their positions meanwhile
    names = [f"c{i}" for i in range(len(given))]
    docs = docs.select(*given).toDF(*names)
    whole = F.coalesce(F.col(names[given.index("text")]), F.lit(""))
    docs = docs.withColumn("_words", text.words(whole)).withColumn(
        "_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    )
    docs = docs.withColumn("_windows", _repeat_positions(F.col("_words")))
    docs = docs.withColumn("_positions", _repeated(F.col("_windows")))
    length = F.aggregate("_words", F.lit(0).cast("bigint"), lambda a, w: a + F.char_length(w))
    counts = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        length.alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _covered(F.col("_positions")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.regexp_count(whole, F.lit("\\p{Lu}")).alias("_upper"),
        F.regexp_count(whole, F.lit("!")).alias("_shouts"),
    )
    # A generated column, since a filter on a plain one would be pushed down with its expression and
    # evaluate the nested array functions once per element.
    docs = docs.select(*names, F.explode_outer(F.array(counts)).alias("_counts")).select(*names, "_counts.*")
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return docs.select(
        *[F.col(n).alias(g) for n, g in zip(names, given)],
        *BASE,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbols"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / n).alias("repeats"),
        (F.col("_upper") / chars).alias("capitals"),
        (F.col("_shouts") / n).alias("shouts"),
        (F.col("word_chars") / n).alias("long_words"),
        (-F.col("word_chars") / n).alias("short_words"),
    )


def allowed_rejections(n: Column, alpha: float, level: Column) -> Column:
    """Largest k with P(X <= k) <= level for X ~ Binomial(n, alpha); -1 if there is none.

    The terms are summed in logarithms from k = 0 on, so large n do not underflow.
    """
    odds = float(alpha / (1 - alpha))
    start = F.struct(
        (n * F.log(F.lit(1.0 - alpha))).cast("double").alias("term"),
        F.lit(float("-inf")).alias("total"),
        F.lit(-1).cast("bigint").alias("k"),
        F.lit(True).alias("open"),
    )

    def add(state, i):
        high = F.greatest(state["total"], state["term"])
        total = high + F.log(F.exp(state["total"] - high) + F.exp(state["term"] - high))
        still = state["open"] & (total <= F.log(level))
        return F.struct(
            (state["term"] + F.log((n - i) / (i + 1.0) * odds)).cast("double").alias("term"),
            total.alias("total"),
            F.when(still, i).otherwise(state["k"]).cast("bigint").alias("k"),
            still.alias("open"),
        )

    # Beyond the mean of the binomial its lower tail exceeds any useful level.
    candidates = F.sequence(F.lit(0).cast("bigint"), F.floor(n * F.lit(alpha)).cast("bigint"))
    return F.when(n > 0, F.aggregate(candidates, start, add, lambda s: s["k"])).otherwise(F.lit(-1).cast("bigint"))


def _beyond(metrics_cutoffs: Column) -> Column:
    """True if any metric lies beyond its cutoff in the array (order of METRICS)."""
    tests = [F.coalesce(F.col(m) > F.get(metrics_cutoffs, F.lit(i)), F.lit(False)) for i, m in enumerate(METRICS)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``_stratum, cutoffs`` (array in the order of METRICS) of the strata that have a certified level.

    ``measured`` comes from :func:`measure`; ``labels`` has doc_id and quality (1 good). Several
    labels of an id count as the worst; null ids and labels count for nothing. Only documents that pass the base rules take
    part. Two grouped passes over the labelled documents; rows per stratum and level are few.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("_quality")
    )
    rows = measured.where(~F.col("base_failed")).select(
        "doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), *METRICS
    )
    labelled = rows.join(marks, "doc_id").withColumn(
        "_holdout", F.pmod(F.crc32(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(2)) == 1
    )
    labelled = materialize(labelled, "labelled")
    good = F.col("_quality") == 1
    shares = [1.0 - e for e in LEVELS]
    quantiles = labelled.where(~F.col("_holdout") & good).groupBy("_stratum").agg(
        *[F.percentile_approx(m, shares, 10_000).alias(f"_q{i}") for i, m in enumerate(METRICS)]
    )
    grid = quantiles.select("_stratum", F.posexplode(F.arrays_zip(*[f"_q{i}" for i in range(len(METRICS))])).alias("level", "q"))
    grid = grid.select("_stratum", "level", F.array(*[F.col("q")[f"_q{i}"] for i in range(len(METRICS))]).alias("cutoffs"))
    grid = pin_small(grid)
    tried = labelled.join(grid, "_stratum").withColumn("_rejected", _beyond(F.col("cutoffs")))
    counted = tried.groupBy("_stratum", "level").agg(
        F.count_if(F.col("_holdout") & good).cast("bigint").alias("n"),
        F.count_if(F.col("_holdout") & good & F.col("_rejected")).cast("bigint").alias("k"),
        F.count_if(~F.col("_holdout") & good).alias("fit_good"),
        F.count_if(~F.col("_holdout") & good & F.col("_rejected")).alias("fit_good_out"),
        F.count_if(~F.col("_holdout") & ~good).alias("fit_bad"),
        F.count_if(~F.col("_holdout") & ~good & F.col("_rejected")).alias("fit_bad_out"),
    )
    strata = counted.select(F.count_distinct("_stratum").alias("_strata"))
    counted = counted.crossJoin(F.broadcast(strata))  # one row
    tested = counted.withColumn("_most", allowed_rejections(F.col("n"), alpha, F.lit(delta) / F.col("_strata")))
    # Levels are nested, so k only grows: those up to the first failure are the ones with k <= _most.
    certified = tested.where(F.col("k") <= F.col("_most")).withColumn(
        "_gain",
        F.col("fit_bad_out") / F.greatest("fit_bad", F.lit(1)) - F.col("fit_good_out") / F.greatest("fit_good", F.lit(1)),
    )
    chosen = certified.groupBy("_stratum").agg(F.max_by("level", F.struct("_gain", -F.col("level"))).alias("level"))
    return chosen.join(grid, ["_stratum", "level"]).select("_stratum", "cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept``: false if the base rules failed or a metric lies beyond its stratum's cutoff.

    Strata without cutoffs keep what passes the base rules. The cutoffs are broadcast if small by a
    checked size, else joined.
    """
    own, limits = unused(measured.columns, "_stratum"), unused(measured.columns, "cutoffs")
    rows = measured.withColumn(own, F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    known = cutoffs.select(F.col("_stratum").alias(own), F.col("cutoffs").alias(limits))
    joined = rows.join(pin_small(known), own, "left")
    kept = ~F.col("base_failed") & ~_beyond(F.coalesce(F.col(limits), F.array().cast("array<double>")))
    return joined.withColumn("kept", kept).drop(own, limits)


def filter_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the calibrated rules keep, with their own columns."""
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], "doc_id", "text", "lang")
    measured = measure(inner)
    cutoffs = calibrate(measured.select("doc_id", "lang", "base_failed", *METRICS), labels)
    kept = judge(measured, cutoffs).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


@query("op4_risk_controlled_rules")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = materialize(measure(docs).drop("text"), "measured")
    judged = judge(measured, calibrate(measured, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "lang", *BASE, "base_failed", "kept", *METRICS)

"""Exact stratified and time-ordered splits, folds and compression by quota."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.functions.scalars import hash_order
from coreloom.operators.bounded import small_rows, typed_literal
from coreloom.operators.ranks import hash_cuts, hash_digits, position_cut, with_position

MAX_CLASSES = 10_000


def class_sizes(df: DataFrame, label: str = "label") -> dict:
    """Rows per class; classes are few by nature, and that is checked."""
    rows = small_rows(df.groupBy(label).count(), MAX_CLASSES, "classes")
    if any(r[label] is None for r in rows):
        raise ValueError(f"rows without a {label}: leave them out or give them a class before splitting")
    return {r[label]: r["count"] for r in rows}


def largest_remainder(sizes: Mapping, total: int, min_per_class: int = 0) -> dict:
    """Split ``total`` over the classes in proportion to their sizes.

    Floors first; the units left go to the largest remainders, ties to the smaller
    label. With ``min_per_class`` each class first keeps that many rows (if it has
    them), taken from the classes with the largest quota.
    """
    n = sum(sizes.values())
    quota = {c: s * total // n for c, s in sizes.items()}
    order = sorted(sizes, key=lambda c: (-(sizes[c] * total % n), c))
    for c in order[: total - sum(quota.values())]:
        quota[c] += 1
    for c in sorted(sizes):
        while quota[c] < min(min_per_class, sizes[c]):
            donor = max(sorted(quota), key=lambda d: quota[d])
            if quota[donor] <= min_per_class:
                break
            quota[donor] -= 1
            quota[c] += 1
    return quota


def with_segment(
    df: DataFrame, label: str, key: str, ends: Mapping[object, Sequence[int]], seed: int = 42, name: str = "segment"
) -> DataFrame:
    """Cut each class, in seeded md5 order of ``key``, at the given cumulative ranks.

    Rows up to the first rank get segment 0, up to the second 1, and so on. The
    rows themselves are never sorted or shuffled: the cut keys (classes x ranks
    strings) are found once, then every row compares its own hash with them.
    """
    spark = df.sparkSession
    label_type = df.schema[label].dataType.simpleString()
    wanted = [(c, int(r)) for c, ranks in ends.items() for r in ranks if r > 0]
    found = {}
    if wanted:
        ranks = spark.createDataFrame(sorted(set(wanted)), f"{label} {label_type}, rank bigint")
        digits = hash_digits(max(r for _, r in wanted))
        cuts = hash_cuts(df, [label], key, F.broadcast(ranks), seed, digits)
        found = {(r[label], r["rank"]): r["cut"] for r in small_rows(cuts, len(wanted), "cuts")}
    table = [(c, [found[(c, int(r))] if r > 0 else "" for r in ranks]) for c, ranks in ends.items()]
    cuts = spark.createDataFrame(table, f"{label} {label_type}, _cuts array<string>")
    passed = F.lit(0)
    for i in range(max(len(ranks) for ranks in ends.values())):
        passed = passed + F.when(F.get("_cuts", F.lit(i)) < F.col("_h"), 1).otherwise(0)
    return (
        df.withColumn("_h", hash_order(F.col(key), seed))
        .join(F.broadcast(cuts), label)
        .withColumn(name, passed)
        .drop("_cuts", "_h")
    )


def stratified_sample(df: DataFrame, quota: Mapping, label: str = "label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly ``quota[class]`` rows of each class."""
    parts = with_segment(df, label, key, {c: [q] for c, q in quota.items()}, seed)
    return parts.where("segment = 0").drop("segment")


def stratified_split(
    df: DataFrame, test_fraction: float = 0.2, label: str = "label", key: str = "row_id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ceil(test_fraction * n) test rows spread over the classes."""
    sizes = class_sizes(df, label)
    quota = largest_remainder(sizes, math.ceil(test_fraction * sum(sizes.values())))
    parts = with_segment(df, label, key, {c: [q] for c, q in quota.items()}, seed)
    return parts.where("segment = 1").drop("segment"), parts.where("segment = 0").drop("segment")


def fold_sizes(sizes: Mapping, k: int) -> dict:
    """Rows of each class in each fold.

    The classes, laid end to end in label order, are dealt round-robin to the folds:
    class counts differ by at most one between folds, and so do the fold totals.
    """
    dealt, start = {}, 0
    for c in sorted(sizes):
        end = start + sizes[c]
        dealt[c] = [(end - 1 - f) // k - (start - 1 - f) // k for f in range(k)]
        start = end
    return dealt


def stratified_folds(df: DataFrame, k: int = 5, label: str = "label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """Attach ``fold`` 0..k-1, stratified by class."""
    ends = {}
    for c, dealt in fold_sizes(class_sizes(df, label), k).items():
        ends[c] = [sum(dealt[: f + 1]) for f in range(k - 1)]
    return with_segment(df, label, key, ends, seed, name="fold")


def ordered_folds(df: DataFrame, k: int = 7, label: str = "label", order: str = "row_id") -> DataFrame:
    """Attach ``fold`` 0..k-1, stratified by class without shuffling.

    Each class is cut in the order of its rows (``order``, a number or time, unique in a class) into runs of the sizes of
    :func:`fold_sizes`. Positions come from offsets of sorted buckets, so no class is sorted whole.
    """
    kind = df.schema[label].dataType.simpleString()
    ends = []
    for c, dealt in fold_sizes(class_sizes(df, label), k).items():
        ends.append((c, [sum(dealt[: f + 1]) for f in range(k - 1)]))
    table = df.sparkSession.createDataFrame(ends, f"{label} {kind}, _ends array<bigint>")
    placed = with_position(df, [label], order, "_at").join(F.broadcast(table), label)
    fold = F.size(F.filter("_ends", lambda end: end <= F.col("_at")))
    return placed.withColumn("fold", fold).select(*df.columns, "fold")


def stratified_compress(
    df: DataFrame,
    fraction: float,
    label: str = "label",
    key: str = "row_id",
    seed: int = 42,
    strict: bool = False,
    min_per_class: int = 0,
) -> DataFrame:
    """floor(fraction * n) rows, spread over the classes by largest remainder.

    ``strict`` refuses, as the usual sampling libraries do, a class of one row or a
    sample smaller than the number of classes.
    """
    sizes = class_sizes(df, label)
    total = math.floor(fraction * sum(sizes.values()) + 1e-9)
    if strict and (min(sizes.values()) < 2 or total < len(sizes)):
        raise ValueError("sample too small for the classes")
    return stratified_sample(df, largest_remainder(sizes, total, min_per_class), label, key, seed)


def guarded_fraction(fraction: float, n_classes: int, n_rows: int) -> float:
    """At least one row per class: the fraction is raised to classes / rows."""
    return max(fraction, n_classes / n_rows)


def stratified_compress_guarded(
    df: DataFrame, fraction: float, n_classes: int | None = None, label: str = "label", key: str = "row_id", seed: int = 42
) -> DataFrame:
    """Compression with the minimum-fraction guard and one row for every class."""
    sizes = class_sizes(df, label)
    n = sum(sizes.values())
    guarded = guarded_fraction(fraction, n_classes or len(sizes), n)
    total = math.floor(guarded * n + 1e-9)
    return stratified_sample(df, largest_remainder(sizes, total, 1), label, key, seed)


def time_split(
    df: DataFrame, ratio: float = 0.8, time: str = "Time", key: str = "row_id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first int(n * ratio) rows by time, equal times in md5 order of ``key``.

    Rows without a time count as the latest.
    """
    n, known = df.agg(F.count(F.lit(1)), F.count(time)).first()
    position = int(n * ratio)
    if position == 0:
        return df.limit(0), df
    unknown = F.col(time).isNull()
    if position >= known:
        # Rows without a time come last, in md5 order of the key.
        first = ~unknown
        if position > known:
            missing = position - known
            cut = hash_cuts(df.where(unknown), [], key, [missing], seed, hash_digits(n - known)).first()["cut"]
            first = first | (hash_order(F.col(key), seed) <= F.lit(cut))
    else:
        text, missing, ties = position_cut(df, time, position)
        at = typed_literal(text, df.schema[time].dataType.simpleString())
        first = F.col(time) < at
        if missing == ties:
            first = first | (F.col(time) == at)
        else:
            cut = hash_cuts(df.where(F.col(time) == at), [], key, [missing], seed, hash_digits(ties)).first()["cut"]
            first = first | ((F.col(time) == at) & (hash_order(F.col(key), seed) <= F.lit(cut)))
    first = F.coalesce(first, F.lit(False))
    return df.where(first), df.where(~first)

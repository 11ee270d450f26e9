"""Exact order statistics without a single-task sort.

Everything here follows one pattern: a bounded sketch gives cut points, rows get a
bucket number by binary search (crowded buckets are divided again, level by level), bucket
totals become offsets on a table of one row per bucket, and sorting only happens inside a bucket. Sketches decide
how even the buckets are, never what the result is. Rows are combined to distinct
values first, so one value held by a third of all rows is one row when sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreloom.functions.scalars import hash_bucket, hash_order
from coreloom.operators.bounded import pin_small, small_rows, typed_literal

# Buckets start at 2**BUCKET_BITS per group and grow until one holds about BUCKET_ROWS rows.
BUCKET_BITS = 8
MAX_BUCKET_BITS = 15
BUCKET_ROWS = 4_000_000
MAX_TREE_BITS = 62


def _search(df: DataFrame, value: str, cuts: Column, bits: int) -> DataFrame:
    """Attach the number of cut points below ``value``: an unrolled binary search.

    One projection per bit keeps every step inside generated code and each step's
    expression small.
    """
    df = df.withColumn("_bucket", F.lit(0))
    for step in (2**b for b in reversed(range(bits))):
        at = F.get(cuts, F.col("_bucket") + F.lit(step - 1))
        df = df.withColumn("_bucket", F.col("_bucket") + F.when(at < F.col(value), F.lit(step)).otherwise(F.lit(0)))
    return df


def _bits_for(rows: int, bits: int) -> int:
    """Bits that leave about BUCKET_ROWS of a group's rows in each bucket."""
    while bits < MAX_BUCKET_BITS and rows > BUCKET_ROWS * 2**bits:
        bits += 1
    return bits


def _sketch(value: str, bits: int) -> Column:
    n = 2**bits
    return F.percentile_approx(value, [i / n for i in range(1, n)], 4 * n)


def _one_level(df: DataFrame, by: list[str], value: str, bits: int) -> tuple[DataFrame, int, int]:
    """``df`` with ``_bucket`` from one sketch per group, the rows of the largest group, and the bits used."""
    if by:
        def cuts_at(b):
            return pin_small(df.groupBy(*by).agg(_sketch(value, b).alias("_cuts"), F.count(value).alias("_rows")))

        cuts = cuts_at(bits)
        rows = cuts.agg(F.max("_rows")).first()[0] or 0
        finer = _bits_for(rows, bits)
        cuts = cuts if finer == bits else cuts_at(finer)
        return _search(df.join(cuts, by), value, F.col("_cuts"), finer).drop("_cuts", "_rows"), rows, finer
    data_type = df.schema[value].dataType.simpleString()

    def found_at(b):
        return df.agg(_sketch(value, b).cast("array<string>").alias("c"), F.count(value).alias("n")).first()

    found = found_at(bits)
    finer = _bits_for(found["n"], bits)
    rows, found = found["n"], found if finer == bits else found_at(finer)
    return _search(df, value, F.lit(found["c"] or []).cast(f"array<{data_type}>"), finer), rows, finer


def _divided(df: DataFrame, by: list[str], value: str, rows: int) -> tuple[DataFrame, int, int]:
    """Divide every crowded bucket by a sketch of its own; the others keep one bucket in the finer numbering.

    ``rows`` is about what the largest bucket holds. Returns the rows of the largest bucket that was divided (0: none was)
    and the bits added. A bucket whose lowest cut is its largest value cannot be divided: nearly all its rows are that value.
    """
    bits = _bits_for(rows, 1)
    sizes = df.groupBy(*by, "_bucket").agg(F.count(value).alias("_rows"), F.max(value).alias("_high"), _sketch(value, bits).alias("_cuts"))
    crowded = sizes.where((F.col("_rows") > BUCKET_ROWS) & (F.get("_cuts", F.lit(0)) < F.col("_high")))
    cuts = pin_small(crowded.drop("_high"))
    largest = cuts.agg(F.max("_rows")).first()[0] or 0
    if not largest:
        return df, 0, 0
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_bucket"]]
    joined = df.alias("l").join(cuts.alias("r"), on, "left").select("l.*", F.col("r._cuts").alias("_cuts"))
    parts = _search(joined.withColumnRenamed("_bucket", "_outer"), value, F.col("_cuts"), bits)
    number = F.col("_outer").cast("bigint") * 2**bits + F.col("_bucket")
    return parts.withColumn("_bucket", number).drop("_outer", "_cuts"), largest, bits


def with_bucket(df: DataFrame, by: Sequence[str], value: str, bits: int = BUCKET_BITS) -> DataFrame:
    """Attach ``_bucket``, monotone in ``value`` within ``by`` and roughly even in rows.

    ``bits`` is a minimum: very large groups get a finer sketch in a second pass, and where the finest one would
    still leave more than BUCKET_ROWS rows in a bucket, crowded buckets are divided again, level by level, so the
    rows of one bucket stay bounded however the data grows (but for the copies of one value, which are combined
    before they are sorted). A number holds MAX_TREE_BITS bits of levels, more than any table can need.
    """
    by = list(by)
    df, rows, used = _one_level(df, by, value, bits)
    left = rows / 2**used
    while left > BUCKET_ROWS and used + MAX_BUCKET_BITS <= MAX_TREE_BITS:
        df, rows, added = _divided(df, by, value, math.ceil(left))
        used, left = used + added, rows / 2**added
    return df


def running_totals(
    df: DataFrame, by: Sequence[str], value: str, measures: dict[str, Column], bits: int = BUCKET_BITS
) -> DataFrame:
    """Per distinct ``value``: each measure's sum and its running sum within ``by``.

    Returns ``by + [value, next_value]`` and, for every measure ``m``, ``m``,
    ``cum_m`` (running sum including this value) and ``tot_m`` (sum of the group).
    ``next_value`` is null at the largest value. Nulls in ``value`` are left out. The
    bucket totals read the same combined rows (one reused exchange), and the in-bucket
    window shares its partitioning with the offset join.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(
        *by, value, *[m.alias(f"_{k}") for k, m in measures.items()]
    )
    rows = with_bucket(rows, by, value, bits)
    distinct = rows.groupBy(*by, "_bucket", value).agg(*[F.sum(f"_{k}").alias(k) for k in measures])
    totals = distinct.groupBy(*by, "_bucket").agg(
        F.min(value).alias("_first"), *[F.sum(k).alias(f"_t_{k}") for k in measures]
    )
    group = Window.partitionBy(*by)
    ordered = group.orderBy("_bucket")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bucket",
        F.lead("_first").over(ordered).alias("_after"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in measures],
        *[F.sum(f"_t_{k}").over(group).alias(f"tot_{k}") for k in measures],
    )
    sorted_inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    inside = sorted_inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return distinct.join(offsets, [*by, "_bucket"]).select(
        *by,
        value,
        F.coalesce(F.lead(value).over(sorted_inside), F.col("_after")).alias("next_value"),
        *measures,
        *[(F.col(f"_o_{k}") + F.sum(k).over(inside)).alias(f"cum_{k}") for k in measures],
        *[f"tot_{k}" for k in measures],
    )


def with_position(df: DataFrame, by: Sequence[str], order: str, name: str = "idx", bits: int = BUCKET_BITS) -> DataFrame:
    """Dense 0-based position of each row within ``by``; ``order`` must be unique there."""
    by = list(by)
    rows = with_bucket(df, by, order, bits)
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order)
    return (
        rows.join(offsets, [*by, "_bucket"])
        .withColumn(name, (F.col("_o") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_bucket", "_o")
    )


def exact_quantiles(
    df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), bits: int = BUCKET_BITS
) -> DataFrame:
    """Linear-interpolated quantiles of a numeric column, exact at any size.

    Only the buckets that hold a wanted rank are sorted. Returns
    ``by + [quantiles array<double>, n bigint]``.
    """
    by = list(by)
    qs = list(qs)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    rows = with_bucket(rows, by, "_v", bits)
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    located = counts.select(
        *by,
        "_bucket",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        F.sum("_n").over(group).alias("_total"),
    ).withColumn("_at", F.transform(F.lit(qs), lambda q: q * (F.col("_total") - 1)))
    end = F.col("_o") + F.col("_n")
    wanted = located.where(
        F.exists(
            "_at",
            lambda p: ((F.floor(p) >= F.col("_o")) & (F.floor(p) < end))
            | ((F.ceil(p) >= F.col("_o")) & (F.ceil(p) < end)),
        )
    ).select(*by, "_bucket", "_o", "_total", "_at")
    kept = rows.join(pin_small(wanted), [*by, "_bucket"])
    distinct = kept.groupBy(*by, "_bucket", "_o", "_total", "_at", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = distinct.withColumn("_cum", F.col("_o") + F.sum("_n").over(inside))
    low, high = [], []
    for i in range(len(qs)):
        at = F.get("_at", F.lit(i))
        low.append(F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))))
        high.append(F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))))
    picked = ranked.groupBy(*by).agg(
        F.max("_total").alias("n"),
        F.max("_at").alias("_at"),
        F.array(*low).alias("_low"),
        F.array(*high).alias("_high"),
    )
    weight = F.transform("_at", lambda p: p - F.floor(p))
    spread = F.zip_with("_high", "_low", lambda h, lo: h - lo)
    return picked.select(
        *by,
        F.zip_with("_low", F.zip_with(spread, weight, lambda s, w: s * w), lambda lo, d: lo + d).alias("quantiles"),
        "n",
    )


def hash_cuts(
    df: DataFrame, by: Sequence[str], key: str, ranks: DataFrame | Sequence[int], seed: int = 42, digits: int = 3
) -> DataFrame:
    """The shuffling keys at given ranks of the seeded md5 order within ``by``.

    ``ranks`` has ``by + [rank]`` (1-based, one or more rows per group) or, without
    groups, is a list of ranks. md5 spreads
    any group evenly over 16**digits buckets, so only the buckets that hold a wanted
    rank are sorted, however large the group. ``key`` must be unique. Returns
    ``by + [rank, cut]``; rows with hash <= cut are the first ``rank`` of the group.
    """
    by = list(by)
    rows = df.select(*by, hash_order(F.col(key), seed).alias("_h")).withColumn(
        "_bucket", hash_bucket(F.col("_h"), digits)
    )
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = counts.withColumn("_end", F.sum("_n").over(upto)).withColumn("_o", F.col("_end") - F.col("_n"))
    if isinstance(ranks, DataFrame):
        located = located.join(ranks, by)
    else:
        located = located.withColumn("rank", F.explode(F.lit([int(r) for r in ranks])))
    wanted = located.where((F.col("rank") > F.col("_o")) & (F.col("rank") <= F.col("_end"))).select(*by, "_bucket", "_o", F.col("rank").cast("bigint").alias("rank"))
    wanted = pin_small(
        wanted.groupBy(*by, "_bucket", "_o").agg(F.collect_set("rank").alias("_ranks"))
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h")
    return (
        rows.join(wanted, [*by, "_bucket"])
        .withColumn("rank", (F.col("_o") + F.row_number().over(inside)).cast("bigint"))
        .where(F.array_contains("_ranks", F.col("rank")))
        .select(*by, "rank", F.col("_h").alias("cut"))
    )


def hash_digits(rows: int) -> int:
    """Hex digits that leave at most BUCKET_ROWS of ``rows`` in one hash bucket (3 at least)."""
    digits = 3
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def position_cut(df: DataFrame, order: str, position: int, bits: int = BUCKET_BITS):
    """The ``order`` value at a 1-based global position, and the rows still needed there.

    Returns ``(value as text, missing, ties)``: all rows below the value plus
    ``missing`` of the ``ties`` rows equal to it make up exactly ``position`` rows.
    Only the bucket that holds the position is sorted; while that is crowded, it alone is divided again.
    """
    known = df.where(F.col(order).isNotNull()).select(order)
    data_type = df.schema[order].dataType.simpleString()
    below, inside, rows = 0, known, None
    while True:
        summary = _one_level(inside, [], order, bits)[0].groupBy("_bucket").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(order).cast("string").alias("low"),
            F.max(order).cast("string").alias("high"),
        )
        for r in sorted(small_rows(summary, 2**MAX_BUCKET_BITS, "buckets"), key=lambda r: r["_bucket"]):
            if below + r["n"] >= position:
                break
            below += r["n"]
        # The bucket's own bounds select its rows, so the filter reaches the scan.
        low, high = typed_literal(r["low"], data_type), typed_literal(r["high"], data_type)
        if r["n"] <= BUCKET_ROWS or r["low"] == r["high"] or r["n"] == rows:
            break
        inside, rows = known.where(F.col(order).between(low, high)), r["n"]
    distinct = known.where(F.col(order).between(low, high)).groupBy(order).agg(F.count(F.lit(1)).alias("n"))
    distinct = distinct.withColumn("_bucket", F.lit(r["_bucket"]))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = (
        distinct.withColumn("cum", below + F.sum("n").over(inside))
        .where(F.col("cum") >= position)
        .agg(F.min_by(F.struct(F.col(order).cast("string").alias("v"), "n", "cum"), order).alias("r"))
        .first()["r"]
    )
    return row["v"], int(position - (row["cum"] - row["n"])), int(row["n"])


__all__ = [
    "BUCKET_BITS",
    "exact_quantiles",
    "hash_cuts",
    "hash_digits",
    "position_cut",
    "running_totals",
    "with_bucket",
    "with_position",
]

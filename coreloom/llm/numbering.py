"""Gapless numbers within groups of any size, without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coreloom.session import materialize

#: About so many rows of a group are sorted together.
SORTED_TOGETHER = 20_000
#: Equal rows are numbered as one and laid out in runs of this many.
RUN = 65_536
HASH_BITS = 52


def number(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Attach ``name``: 0, 1, 2, ... within ``by``, in the order of a hash of the whole row.

    The numbers depend on the rows alone, not on files or partitions. Every group is
    split by the leading bits of the hash into sorted portions whose sizes become
    offsets; equal rows are combined first and expanded at the end, so neither a
    large group nor one row repeated many times lands in one sort. ``by`` columns
    must not be null; rows should be narrow, since they are shuffled whole.
    """
    given, columns = rows.columns, [f"c{i}" for i in range(len(rows.columns))]  # inner columns begin with an underscore
    by = [columns[given.index(c)] for c in by]
    rows = rows.toDF(*columns)
    combined = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    hashed = F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)
    combined = materialize(combined.withColumn("_h", hashed), "numbered")
    total, most = combined.agg(F.sum("_n"), F.max("_n")).first()
    bits = 4
    while (total or 0) > SORTED_TOGETHER * 2**bits:
        bits += 1
    portioned = combined.withColumn("_portion", F.shiftright(F.col("_h"), HASH_BITS - bits))
    counts = portioned.groupBy(*by, "_portion").agg(F.sum("_n").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_portion").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_portion", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = (
        Window.partitionBy(*by, "_portion").orderBy("_h", *columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    first = portioned.join(offsets, [*by, "_portion"]).select(
        *columns, "_n", (F.col("_o") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_first")
    )
    runs = first.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(RUN).cast("bigint"))).alias("_run")
    )
    if (most or 0) > RUN:
        runs = runs.repartition(*columns, "_run")
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(RUN).cast("bigint"), F.col("_n") - F.col("_run")) - 1)
    return runs.select("*", F.explode(steps).alias("_step")).select(
        *[F.col(c).alias(g) for c, g in zip(columns, given)],
        (F.col("_first") + F.col("_run") + F.col("_step")).cast("bigint").alias(name),
    )

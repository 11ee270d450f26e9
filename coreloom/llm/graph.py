"""Connected components of a table of links, by alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.session import materialize


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One rewrite: connect a vertex's neighbours to the smallest vertex around it."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(lowest, "u")
    if larger_only:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = lowest.select("u", F.col("m").alias("v"))
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``edges(u, v)`` (bigint, either order).

    Returns ``(vertex, component)`` for every vertex that has a link; self links and
    rows with a null end count for nothing. Each round is two grouped minima and two
    joins over the links left; its result is written to the shared folder, so lost
    executors cost a re-read and the plan stays short. Stops when a round changes
    nothing; the number of rounds grows with the logarithm of the longest chain.
    """
    current = materialize(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(current)
    while before[0]:
        current = materialize(_star(_star(current, True), False), "links")
        now = mark(current)
        if now == before:
            break
        before = now
    stars = current.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)

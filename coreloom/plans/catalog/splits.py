"""Splits, folds, stratified samples and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from coreloom.functions.scalars import clean
from coreloom.operators import features as FE
from coreloom.operators import split
from coreloom.plans import standins as S
from coreloom.plans.catalog import sql as Q
from coreloom.plans.catalog.registry import query

# Largest-remainder quotas per class for a wanted total, then the md5 order inside a class.
QUOTAS = """
sizes AS (SELECT label, count(*) AS n FROM {rows} GROUP BY label),
base AS (SELECT label, n, n * {total} // (SELECT sum(n) FROM sizes) AS q,
                n * {total} % (SELECT sum(n) FROM sizes) AS rest FROM sizes),
quota AS (SELECT label, q + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                 <= {total} - (SELECT sum(q) FROM base) THEN 1 ELSE 0 END AS quota FROM base),
ranked AS (SELECT t.*, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn FROM {rows} t)"""


def quotas(rows: str, total: str) -> str:
    return QUOTAS.format(rows=rows, total=total)


_TEST = "CAST(ceil(0.2 * (SELECT count(*) FROM lines)) AS BIGINT)"


@query(
    "stratified_split",
    f"""WITH {Q.LINES},{quotas('lines', _TEST)}
    SELECT row_id, label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part FROM ranked JOIN quota USING (label)""",
)
def stratified_split(spark, sf):
    train, test = split.stratified_split(S.wide_num(spark, sf))
    parts = [p.select("row_id", "label", F.lit(n).alias("part")) for n, p in (("train", train), ("test", test))]
    return parts[0].unionAll(parts[1])


@query(
    "stratified_sample",
    f"""WITH {Q.VECTORS}, ranked AS (SELECT row_id, label,
      row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn FROM vectors)
    SELECT row_id, label FROM ranked WHERE rn <= 7""",
)
def stratified_sample(spark, sf):
    rows = S.features(spark, sf)
    quota = dict.fromkeys(split.class_sizes(rows), 7)
    return split.stratified_sample(rows, quota).select("row_id", "label")


@query(
    "stratified_compress",
    f"""WITH {Q.LINES},{quotas('lines', "CAST(floor((SELECT count(*) FROM lines) / 50) AS BIGINT)")}
    SELECT row_id, label FROM ranked JOIN quota USING (label) WHERE rn <= quota""",
)
def stratified_compress(spark, sf):
    return split.stratified_compress(S.wide_num(spark, sf), 1 / 50).select("row_id", "label")


@query(
    "stratified_compress_guarded",
    f"""WITH {Q.VECTORS}, ranked AS (SELECT row_id, label,
      row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn FROM vectors)
    SELECT row_id, label FROM ranked WHERE rn <= 1""",
)
def stratified_compress_guarded(spark, sf):
    """A fraction far below classes / rows: the guard leaves one row for each class."""
    return split.stratified_compress_guarded(S.features(spark, sf), 0.001).select("row_id", "label")


@query(
    "time_split",
    f"""WITH {Q.LINES}, ranked AS (SELECT row_id, l_shipdate,
      row_number() OVER (ORDER BY l_shipdate, md5('42:' || row_id)) AS rn, count(*) OVER () AS n FROM lines)
    SELECT row_id, l_shipdate, CASE WHEN rn <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM ranked""",
)
def time_split(spark, sf):
    train, test = split.time_split(S.wide_num(spark, sf), 0.8, "l_shipdate")
    parts = [p.select("row_id", "l_shipdate", F.lit(n).alias("part")) for n, p in (("train", train), ("test", test))]
    return parts[0].unionAll(parts[1])


_FOLDS = ", ".join(
    f"CAST(floor((e - 1 - {f}) / 5.0) - floor((s - 1 - {f}) / 5.0) AS BIGINT) AS z{f}" for f in range(5)
)
_FOLD = " + ".join(f"CAST(rn > {' + '.join(f'z{g}' for g in range(f + 1))} AS INTEGER)" for f in range(4))


@query(
    "stratified_folds",
    f"""WITH {Q.LINES}, sizes AS (SELECT label, sum(count(*)) OVER (ORDER BY label) AS e, count(*) AS n FROM lines GROUP BY label),
    dealt AS (SELECT label, {_FOLDS} FROM (SELECT label, e, e - n AS s FROM sizes)),
    ranked AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn FROM lines)
    SELECT row_id, label, CAST({_FOLD} AS INTEGER) AS fold FROM ranked JOIN dealt USING (label)""",
)
def stratified_folds(spark, sf):
    return split.stratified_folds(S.wide_num(spark, sf), 5).select("row_id", "label", "fold")


# Classes laid end to end in label order and dealt round-robin to 7 folds; each class cut at the running sums.
_DEALT = ", ".join(f"(e - 1 - {f} + 7) // 7 - (s - 1 - {f} + 7) // 7 AS n{f}" for f in range(7))
_CUTS = " + ".join(f"CASE WHEN rn > {' + '.join(f'n{g}' for g in range(f + 1))} THEN 1 ELSE 0 END" for f in range(6))


@query(
    "ordered_folds",
    f"""WITH sizes AS (SELECT label, sum(count(*)) OVER (ORDER BY label) AS e, count(*) AS n FROM embeddings GROUP BY label),
    dealt AS (SELECT label, {_DEALT} FROM (SELECT label, e, e - n AS s FROM sizes)),
    ranked AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
    SELECT vec_id AS row_id, label, CAST({_CUTS} AS INTEGER) AS fold FROM ranked JOIN dealt USING (label)""",
)
def ordered_folds(spark, sf):
    return split.ordered_folds(S.features(spark, sf), 7).select("row_id", "label", "fold")


@query(
    "class_weights",
    f"""WITH {Q.LINES} SELECT label, count(*) AS n,
    {Q.r('(SELECT count(*) FROM lines) / (count(*) OVER () * CAST(count(*) AS DOUBLE))')} AS weight FROM lines GROUP BY label""",
)
def class_weights(spark, sf):
    lines = S.wide_num(spark, sf)
    weighted = lines.select("label", FE.class_weight(lines).alias("w"))
    return weighted.groupBy("label").agg(F.count(F.lit(1)).alias("n"), clean(F.max("w")).alias("weight"))

"""Exact duplicates by distributed most-significant-digit radix partitioning.

Documents are split by their length (texts that end at different depths are never equal) and their first bytes,
then by the next bytes, and so on, until a group holds one document or its texts have ended. A group's key
is the group it came from and the next bytes themselves, so equality is that of the bytes; no digest decides it. The
digits grow from round to round (64 bytes, then 16 times more each time), so a text of any length takes a few rounds, and
only documents whose group still has company carry their remaining bytes into the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.llm.registry import query, table
from coreloom.session import materialize

#: Bytes of the first digit, and how much wider the next one is each time.
FIRST_BYTES = 64
GROWTH = 16
#: No digit is wider (array offsets are 32-bit).
WIDEST = 1 << 30
#: A group with more than this part of the rows counts as hot (so there are at most as many) and is spread.
HOT_PART = 1_000
SPREAD = 32
#: Tables of groups up to these sizes are broadcast; larger ones are joined with hot groups spread.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def attach(rows: DataFrame, groups: DataFrame, on: list[str], hot: DataFrame, hot_on: list[str]) -> DataFrame:
    """``rows`` left-joined with the written ``groups``, whose rows are unique in ``on``.

    Small tables (by a check of their rows and bytes) are broadcast. Else the rows of ``hot`` keys (``hot_on``, part of
    ``on``; at most HOT_PART of them) are dealt to SPREAD tasks by doc_id and their groups are repeated for each.
    """
    width = sum((F.octet_length(c) for c, kind in groups.dtypes if kind == "binary"), F.lit(8 * len(groups.columns)))
    count, size = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if count <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), on, "left")
    marks = F.broadcast(hot.select(*hot_on, F.lit(SPREAD).alias("_spread")))
    spread = F.coalesce("_spread", F.lit(1))
    dealt = rows.join(marks, hot_on, "left").withColumn("_part", F.pmod(F.xxhash64("doc_id"), spread).cast("int"))
    each = groups.join(marks, hot_on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), spread - 1)))
    return dealt.drop("_spread").join(each.drop("_spread"), [*on, "_part"], "left").drop("_part")


def _split(rows: DataFrame, by: str, width: int, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One round: the rows with their new ``_group`` and ``_size`` (null for a document that is alone), and the hot groups.

    Rows have ``doc_id, text_sha256, _length, _rest`` and ``by`` (their group so far); ``_rest`` loses its first ``width`` bytes.
    """
    keys = [by, "_head"]
    headed = rows.withColumn("_head", F.substring("_rest", 1, width))
    counted = headed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1)
    groups = materialize(counted.withColumn("_new", F.monotonically_increasing_id()), "groups")
    total = groups.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    crowded = groups.where(F.col("_size") * HOT_PART > total)
    if hot is None:  # the first digit is narrow, so a hot group's own key is broadcast
        joined = attach(headed, groups, keys, crowded, keys)
    else:
        joined = attach(headed, groups, keys, hot, [by])
    more = F.col("_new").isNotNull() & (F.octet_length("_rest") > width)
    split = materialize(
        joined.select(
            "doc_id",
            "text_sha256",
            F.col("_new").alias("_group"),
            "_size",
            F.when(more, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "split",
    )
    return split, crowded.select(F.col("_new").alias("_group"))


def duplicate_groups(docs: DataFrame, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``; needs ``doc_id`` and ``text``.

    Rows with byte-equal texts are a group, of which the row with the largest doc_id stays (null is smallest; of fully
    equal rows one stays). A null text counts as empty, and all empty texts are equal. Other columns are not read. An
    empty table gives no rows. The digest is for the reader alone.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.sha2(body, 256).alias("text_sha256"),
        F.octet_length(body).alias("_length"),
        body.alias("_rest"),
    )
    by, width, hot, done = "_length", first_bytes, None, []
    while True:
        split, hot = _split(rows, by, width, hot)
        done.append(split.where(F.col("_rest").isNull()).drop("_rest").withColumn("_round", F.lit(len(done))))
        rows, by = split.where(F.col("_rest").isNotNull()).drop("_size", "_row"), "_group"
        if rows.isEmpty():
            break
        width = min(width * GROWTH, WIDEST)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    ended = found.where(F.col("_group").isNotNull())
    place = ["_round", "_group"]
    best = ended.groupBy(*place).agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.max("_size").alias("_size"))
    best = materialize(best, "best")
    total = best.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    crowded = best.where(F.col("_size") * HOT_PART > total).select(*place)
    judged = attach(found.drop("_size"), best, place, crowded, place)
    alone = F.col("_best").isNull()
    return judged.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_best.doc_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_row") == F.col("_best._row"))).alias("kept"),
        "text_sha256",
    )


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op13_radix_exact_dedup", SQL)
def op13(spark, sf_dir):
    return duplicate_groups(table(spark, sf_dir, "documents"))

"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Fingerprints that differ in at most
``RADIUS`` bits differ in at most that many bytes, so a linked pair shares at least
8 - RADIUS positional bytes. The index posts each *distinct* fingerprint under six
keys of four positional bytes, chosen so that any such pair meets under one of them
(keys of one byte would hold a 256th of all documents each). Pairs that meet get a tally
of all their shared positional bytes; those that reach the minimum are verified by
their differing bits.

A key under which very many fingerprints meet (near copies of one text) is not
expanded into pairs. Its members are posted under themselves and their 64 one-bit
neighbours instead: two fingerprints differ in at most two bits exactly when they
have such a posting in common, and everything under one posting is linked, so linking
each member to the smallest loses no connection and stays proportional to the members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreloom.llm import simhash, text
from coreloom.llm.blocks import covering_sets, mask_of, signed
from coreloom.llm.graph import components
from coreloom.llm.registry import query, table
from coreloom.operators.bounded import join_summary, pin_small
from coreloom.session import materialize

POSITIONS = 8
RADIUS = 2
KEY_POSITIONS = 4
#: Members of one key that are compared pair by pair; keys with more take the one-bit postings.
PAIRWISE = 24


def fingerprint(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fingerprint`` (bigint) of each row's whole text.

    Every row keeps its own result, also with repeated or null ids. Null and empty texts, and texts
    without a word, have fingerprint 0. Only counters leave the task that reads a
    text, however long it is.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col("text").alias("_text"))
    rows = rows.select("_row", *keep, text.words(text.lower_ascii(F.col("_text"))).alias("_words"))
    rows = rows.select("_row", *keep, text.shingles(F.col("_words"), shingle).alias("_shingles"))
    terms = rows.select("_row", *keep, F.explode_outer("_shingles").alias("_term"))
    terms = terms.select("_row", *keep, F.when(F.col("_term").isNotNull(), F.xxhash64("_term")).alias("_h"))
    votes = terms.groupBy("_row", *keep).agg(*simhash.vote_sums(F.col("_h")))
    return votes.select(*keep, simhash.majority().alias("fingerprint"))


def shared_bytes(a, b):
    """Number of positions at which two fingerprints have the same byte."""
    different = a.bitwiseXOR(b)
    return sum(
        F.when(different.bitwiseAND(F.lit(signed(255 << 8 * i))) == 0, 1).otherwise(0) for i in range(POSITIONS)
    )


def links(distinct: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by + (u, v)``: enough of the pairs within RADIUS bits to connect all of them.

    ``distinct`` has one row per different ``fingerprint`` within ``by``; only those of equal ``by`` are linked.
    """
    sets = covering_sets(POSITIONS, KEY_POSITIONS, RADIUS)
    masks = F.array(*[F.lit(mask_of(s, POSITIONS)).cast("bigint") for s in sets])
    posted = distinct.select(*by, "fingerprint", F.posexplode(masks).alias("list", "mask")).select(
        *by, "list", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), "fingerprint"
    )
    place = [*by, "list", "key"]
    met = posted.groupBy(*place).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    posted = materialize(posted.join(met, place), "postings")
    few = posted.where(F.col("members") <= PAIRWISE)
    left = few.select(*place, F.col("fingerprint").alias("u"))
    right = few.select(*place, F.col("fingerprint").alias("v"))
    pairs = (
        left.join(right, place)
        .where(F.col("u") < F.col("v"))
        .withColumn("tally", shared_bytes(F.col("u"), F.col("v")))
        .where(F.col("tally") >= POSITIONS - RADIUS)
        .where(simhash.distance(F.col("u"), F.col("v")) <= RADIUS)
        .select(*by, "u", "v")
        .distinct()
    )
    many = posted.where(F.col("members") > PAIRWISE).select(*by, "fingerprint").distinct()
    flips = F.array(*[F.lit(signed(1 << b)).cast("bigint") for b in range(64)], F.lit(0).cast("bigint"))
    around = many.select(*by, "fingerprint", F.explode(flips).alias("flip")).select(
        *by, F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("posting"), "fingerprint"
    )
    lowest = around.groupBy(*by, "posting").agg(
        F.min("fingerprint").alias("u"), F.count(F.lit(1)).alias("members")
    ).where(F.col("members") > 1).drop("members")
    stars = around.join(lowest, [*by, "posting"]).select(*by, "u", F.col("fingerprint").alias("v")).where("u <> v").distinct()
    return pairs.unionByName(stars)


def classes(fingerprints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``component_id``: the smallest ``key`` reachable over links, itself included.

    Rows with equal fingerprints are one class from the start (combined before any
    shuffle), and a fingerprint that very many rows share is dealt to several tasks. Null keys join in, but are never the smallest unless a class has no
    other. ``fingerprints`` is read more than once: pass a written table.
    """
    distinct = materialize(
        fingerprints.groupBy("fingerprint").agg(F.min(key).alias("_smallest"), F.count(F.lit(1)).alias("size")), "fingerprints"
    )
    reached = components(links(distinct.select("fingerprint")))
    lowest = (
        distinct.join(reached, distinct["fingerprint"] == reached["vertex"])
        .groupBy("component")
        .agg(F.min("_smallest").alias("_lowest"))
    )
    joined = reached.join(lowest, "component").select(F.col("vertex").alias("fingerprint"), "_lowest")
    chosen = distinct.join(joined, "fingerprint", "left").select(
        "fingerprint", F.coalesce("_lowest", "_smallest").alias("component_id")
    )
    return join_summary(fingerprints, chosen, "fingerprint", key, distinct)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (hex) and ``component_id`` of every row of ``docs``."""
    prints = materialize(fingerprint(docs, shingle), "prints")
    return classes(prints).select("doc_id", simhash.hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when each component of linked fingerprints (see :func:`classes`) keeps one row.

    The row with the smallest doc_id stays (null last; of rows that share it, the one whose text's md5 is smallest; of fully equal
    ones any). All columns and texts are untouched, whatever the columns' names; null, empty and wordless texts
    have fingerprint 0 and are linked like any other. An empty table stays empty. Rows are told apart by doc_id and the
    128-bit md5 of the text. The keys of the rows to drop are broadcast if small by a checked size, else joined. ``docs`` is
    read more than once: pass a written table.
    """
    mark = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    prints = fingerprint(docs.select("doc_id", "text", mark.alias("_mark")), shingle, ("doc_id", "_mark"))
    prints = materialize(prints, "prints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_mark").alias("mark"))
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min(place).alias("_first")), "fingerprints")
    reached = components(links(distinct.select("fingerprint"))).withColumnRenamed("vertex", "fingerprint")
    group = F.coalesce("component", "fingerprint")
    firsts = distinct.join(reached, "fingerprint", "left").groupBy(group.alias("_group")).agg(F.min("_first").alias("_first"))
    firsts = materialize(firsts.select(F.col("_first.id").alias("_id"), F.col("_first.mark").alias("_own")), "firsts")
    keys = prints.groupBy("doc_id", "_mark").agg(F.count(F.lit(1)).alias("_copies"))
    keys = materialize(keys.select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_own"), "_copies"), "keys")

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["_id"].eqNullSafe(right["_id"]) & (left["_own"] == right["_own"])

    dropped = pin_small(keys.join(firsts, same(keys, firsts), "left_anti").select("_id", "_own"))
    repeated = pin_small(keys.where("_copies > 1").join(firsts, same(keys, firsts), "left_semi").select("_id", "_own"))
    rows = docs.select(F.struct("*").alias("_whole"), F.col("doc_id").alias("_id"), mark.alias("_own"))
    kept = rows.join(dropped, same(rows, dropped), "left_anti")
    if not repeated.isEmpty():
        single = kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(["_id", "_own"])
        kept = kept.join(repeated, same(kept, repeated), "left_anti").unionByName(single)
    return kept.select("_whole.*")


@query("op8_simhash_near_dedup")
def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

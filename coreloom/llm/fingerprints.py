"""SimHash fingerprints of documents, and search within a Hamming radius.

Terms are words; a term votes with its hash, weighted by its occurrences times
its length class, so that the short words every text has weigh little. The search
keeps permuted block tables: the 64 bits are cut into ``RADIUS`` + 2 blocks, and a
fingerprint is filed once for each choice of two blocks, under those blocks' bits.
Fingerprints within the radius differ in at most RADIUS blocks, so they agree on one
such choice at least, and one lookup in each table finds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreloom.llm import simhash, text
from coreloom.llm.blocks import covering_sets, mask_of
from coreloom.llm.registry import query, table
from coreloom.session import materialize

RADIUS = 3
KEY_BLOCKS = 2
#: Documents whose neighbours are looked up: every id divisible by this.
QUERY_EVERY = 50
#: Documents are laid out in portions of about this many consecutive ids, in at most MAX_CUTS + 1 portions.
PORTION_ROWS = 2_000
MAX_CUTS = 4_095


def term_weight(word: Column) -> Column:
    """1 for words of up to 3 characters, 2 up to 6, else 3."""
    return F.when(F.char_length(word) <= 3, 1).when(F.char_length(word) <= 6, 2).otherwise(3).cast("bigint")


def votes(rows: DataFrame, keep: list[str], words: str) -> DataFrame:
    """One row per ``keep`` with the ``fingerprint`` (bigint) of its words; no words give 0.

    ``keep`` must identify the rows. The word rows are summed in the task that makes them.
    """
    terms = rows.select(*keep, F.explode_outer(words).alias("_word"))
    hashed = terms.select(
        *keep,
        F.when(F.col("_word").isNotNull(), F.xxhash64("_word")).alias("_hash"),
        F.coalesce(term_weight(F.col("_word")), F.lit(0).cast("bigint")).alias("_weight"),
    )
    summed = hashed.groupBy(*keep).agg(*simhash.vote_sums(F.col("_hash"), F.col("_weight")))
    return summed.select(*keep, simhash.majority().alias("fingerprint"))


def _portions(keys: DataFrame, rows: int) -> tuple[list[int], Column]:
    """Cut points of the order and the expression of a row's portion.

    The order is ``_s`` ascending, then ``_t``. An id that many rows share fills several cut
    points; its rows are spread over their portions by ``_t``.
    """
    wanted = min(MAX_CUTS, rows // PORTION_ROWS)
    if wanted < 1:
        return [], F.lit(0)
    shares = [i / (wanted + 1) for i in range(1, wanted + 1)]
    cuts = sorted(keys.agg(F.percentile_approx("_s", shares, 4 * (wanted + 1))).first()[0] or [])
    size = 1
    while size <= len(cuts):
        size *= 2
    padded = F.lit(cuts + [None] * (size - 1 - len(cuts))).cast("array<bigint>")
    steps = F.lit([size >> k for k in range(1, size.bit_length())])

    def below(strict: bool) -> Column:
        def go(at, step):
            cut = F.get(padded, at + step - 1)
            hit = cut < F.col("_s") if strict else cut <= F.col("_s")
            return at + F.when(hit, step).otherwise(F.lit(0))

        return F.aggregate(steps, F.lit(0), go)

    return cuts, F.struct(below(True).alias("lt"), below(False).alias("le"))


def _ordered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _s, _t``: descending ids, null last; equal ids by a hash of the text, then the text."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        whole.alias("text"),
        F.coalesce(F.bitwise_not(F.col("doc_id").cast("bigint")), F.lit((1 << 63) - 1)).alias("_s"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), whole), 12).alias("_t"),
    )


def _with_portion(rows: DataFrame, found: Column, spread: bool) -> DataFrame:
    if not spread:
        return rows.withColumn("_portion", F.lit(0))
    rows = rows.withColumn("_found", found)
    equal = F.col("_found.le") - F.col("_found.lt")
    inside = F.floor(F.col("_t") / F.lit(float(1 << 52)) * equal).cast("int")
    return rows.withColumn("_portion", F.col("_found.lt") + F.when(equal > 1, inside).otherwise(F.lit(0))).drop("_found")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document beside the next one in descending ids (after the last: the first).

    Returns ``doc_id, text, next_text`` and the row's place ``_portion, _at`` and its successor's
    ``_next_portion, _next_at``. Rows are laid out in portions of consecutive ids, each sorted in one
    task; the first row of a portion is also sent to the portion before it, so texts are shuffled
    once. Null texts count as empty.
    """
    ordered = _ordered(docs)
    rows = docs.count()
    cuts, found = _portions(ordered, rows)
    keyed = _with_portion(ordered, found, bool(cuts))
    # At most MAX_CUTS + 1 rows: the first place of each portion and the portion before it.
    firsts = keyed.groupBy("_portion").agg(F.min(F.struct("_s", "_t")).alias("_first"))
    listed = sorted(firsts.collect(), key=lambda r: r["_portion"])
    heads = [
        (r["_portion"], r["_first"]["_s"], r["_first"]["_t"], listed[i - 1]["_portion"]) for i, r in enumerate(listed)
    ]
    spark = docs.sparkSession
    head = spark.createDataFrame(heads, "_portion int, _first_s bigint, _first_t bigint, _before int")
    own = F.struct(F.col("_portion").alias("portion"), F.lit(False).alias("guest"))
    other = F.struct(F.col("_before").alias("portion"), F.lit(True).alias("guest"))
    leads = (F.col("_s") == F.col("_first_s")) & (F.col("_t") == F.col("_first_t"))
    sent = keyed.join(F.broadcast(head), "_portion").withColumn(
        "_to", F.explode(F.when(leads, F.array(own, other)).otherwise(F.array(own)))
    )
    sent = sent.select(
        "doc_id", "text", "_s", "_t", F.col("_to.portion").alias("_portion"), F.col("_to.guest").alias("_guest"),
        F.col("_portion").alias("_home"),
    )
    order = Window.partitionBy("_portion").orderBy("_guest", "_s", "_t", "text")
    placed = sent.select(
        "doc_id", "text", "_guest", "_portion",
        F.row_number().over(order).alias("_at"),
        F.lead("text").over(order).alias("next_text"),
        F.lead("_guest").over(order).alias("_next_guest"),
        F.lead("_home").over(order).alias("_next_home"),
    )
    return placed.where(~F.col("_guest")).select(
        "doc_id", "text", "next_text", "_portion", "_at",
        F.col("_next_home").alias("_next_portion"),
        F.when(F.col("_next_guest"), F.lit(1)).otherwise(F.col("_at") + 1).alias("_next_at"),
    )


def edited(own: Column, following: Column) -> Column:
    """The last third (rounded down) of a text's code points replaced by as many of the next text's."""
    n = F.char_length(own)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(own, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses (one row per row of ``docs``)."""
    rows = with_next(docs).withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    place = ["_portion", "_at", "_next_portion", "_next_at", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn(
        "edited_sha256", F.sha2("_edited", 256)
    )
    both = rows.select(
        *place,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("which"), F.col("_edited").alias("text")),
            )
        ).alias("_one"),
    )
    both = both.select(*place, F.col("_one.which").alias("_which"), text.words(F.col("_one.text")).alias("_words"))
    prints = votes(both, [*place, "_which"], "_words")
    beside = materialize(
        prints.groupBy(*place).agg(
            F.max(F.when(F.col("_which") == 0, F.col("fingerprint"))).alias("own"),
            F.max(F.when(F.col("_which") == 1, F.col("fingerprint"))).alias("changed"),
        ),
        "fingerprints",
    )
    following = beside.select(
        F.col("_portion").alias("_next_portion"), F.col("_at").alias("_next_at"), F.col("own").alias("following")
    )
    return beside.join(following, ["_next_portion", "_next_at"]).select(
        "doc_id", "n_chars", "edited_sha256", "own", "changed", "following"
    )


def neighbours(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(query, match)``: all pairs of fingerprints within ``radius`` bits, equal ones included.

    Both tables have one row per different ``fingerprint`` (bigint). Only the corpus rows filed
    under a block that some query has meet a query.
    """
    blocks = radius + KEY_BLOCKS
    masks = [mask_of(s, blocks) for s in covering_sets(blocks, KEY_BLOCKS, radius)]

    def filed(df, name):
        tables = F.array(*[F.lit(m).cast("bigint") for m in masks])
        return df.select(F.col("fingerprint").alias(name), F.posexplode(tables).alias("table", "mask")).select(
            "table", F.col(name).bitwiseAND(F.col("mask")).alias("block"), name
        )

    met = filed(queries, "query").join(filed(corpus, "match"), ["table", "block"])
    return met.where(simhash.distance(F.col("query"), F.col("match")) <= radius).select("query", "match").distinct()


def near_counts(prints: DataFrame, every: int = QUERY_EVERY, radius: int = RADIUS) -> DataFrame:
    """``fingerprint, near_docs``: other documents within ``radius``, for fingerprints of the query ids."""
    corpus = materialize(
        prints.groupBy("fingerprint").agg(
            F.count(F.lit(1)).alias("copies"), F.max((F.col("doc_id") % every == 0).cast("int")).alias("asked")
        ),
        "classes",
    )
    pairs = neighbours(corpus.where("asked = 1"), corpus, radius)
    sizes = corpus.select(F.col("fingerprint").alias("match"), "copies")
    return pairs.join(sizes, "match").groupBy(F.col("query").alias("fingerprint")).agg(
        (F.sum("copies") - 1).cast("bigint").alias("near_docs")
    )


@query("op6_simhash_fingerprints")
def op6(spark, sf_dir):
    rows = materialize(compared(table(spark, sf_dir, "documents")), "compared")
    near = near_counts(rows.select("doc_id", F.col("own").alias("fingerprint")))
    rows = rows.join(near.withColumnRenamed("fingerprint", "own"), "own", "left")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.hex64(F.col("own")).alias("fingerprint"),
        simhash.hex64(F.col("changed")).alias("edited_fingerprint"),
        simhash.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        simhash.likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.when(F.col("doc_id") % QUERY_EVERY == 0, F.col("near_docs")).alias("near_docs"),
    )

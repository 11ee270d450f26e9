"""Ranked lexical search by a dual tree over items and documents.

A document is the vector of its parts of a score, one coordinate per term that an item holds; an item is the vector of its
terms' weights, and a score is their inner product. All numbers are whole and at least 0, so the
product of the coordinate maxima of a group of items and of a group of documents bounds every score between
them. Documents are sorted by their rarest terms, so that neighbours are alike; every task cuts its sorted
rows into chunks, builds a tree of maxima over each, and descends it together with the tree of the items: a
pair of nodes whose bound is below the weakest kth score of the node's items is dropped with all that lies beneath
it. A first descent that follows only the best nodes gives every item a kth score that some documents
reach; the second one starts from these and is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coreloom.llm.registry import query, table
from coreloom.session import materialize

BEST = 10
#: Children of a node, in both trees.
FAN = 8
#: Document nodes that the first descent follows per item node and level.
FOLLOWED = 4
#: Cells of a dense table of documents (or items) by terms.
CELLS = 4_000_000
#: Doubles hold whole numbers up to this; larger scores are computed in 64-bit integers.
WHOLE = 2.0**53
#: No single term's part of a score reaches this.
PART_BOUND = 1_000_000

#: ASCII characters other than digits and letters become a space, capitals small letters; other bytes stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and all characters beyond ASCII; only A-Z lower-cased; none for null."""
    return text.translate(_FOLD).split() if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def nodes_over(leaves: np.ndarray, of=np.maximum) -> list[np.ndarray]:
    """Levels of a tree: the leaves first, each next level the extremes of FAN rows of the one below, up to one row."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(of.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    return levels


def alike_first(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which like ones are neighbours: halves along the coordinate that varies most."""

    def halves(some: np.ndarray) -> Iterator[np.ndarray]:
        if len(some) <= FAN:
            yield some
            return
        widest = int(np.argmax(rows[some].var(axis=0)))
        some = some[np.argsort(rows[some, widest], kind="stable")]
        half = -(-len(some) // (2 * FAN)) * FAN
        yield from halves(some[:half])
        yield from halves(some[half:])

    return np.concatenate(list(halves(np.arange(len(rows))))) if len(rows) else np.arange(0)


class ItemTree:
    """Coordinate maxima over a block of items (rows of ``weights``), and the weakest kth scores."""

    def __init__(self, weights: np.ndarray, floors: np.ndarray):
        self.order = alike_first(weights)
        self.levels = nodes_over(weights[self.order])
        self.used = [[np.flatnonzero(row) for row in level] for level in self.levels]
        self.floors = floors[self.order]
        self.k: int = BEST
        self.scores: list[np.ndarray] = [np.empty(0, dtype=np.int64) for _ in self.order]
        self.ids: list[np.ndarray] = [np.empty(0, dtype=np.int64) for _ in self.order]

    def weakest(self) -> list[np.ndarray]:
        return nodes_over(self.floors, np.minimum) if len(self.floors) else [self.floors]

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge documents into an item's best: higher scores first, then smaller ids."""
        scores, ids = np.r_[self.scores[item], scores], np.r_[self.ids[item], ids]
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[best], ids[best]
        if len(best) == self.k:
            self.floors[item] = max(self.floors[item], scores[best[-1]])


def _children(nodes: np.ndarray, count: int) -> np.ndarray:
    below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    return below[below < count]


def descend(items: ItemTree, parts: np.ndarray, ids: np.ndarray, followed: int | None = None) -> None:
    """Offer a chunk of documents to the items, level by level; with ``followed`` only that many best nodes per level."""
    docs = nodes_over(parts)
    weakest = items.weakest()
    height = max(len(docs), len(items.levels))
    alive = {0: np.zeros(1, dtype=np.int64)}  # item node -> document nodes; both trees from their roots
    item_level, doc_level = len(items.levels) - 1, len(docs) - 1
    for level in range(height - 1, -1, -1):
        if level < item_level:
            alive = {int(c): n for i, n in alive.items() for c in _children(np.array([i]), len(items.levels[level]))}
            item_level = level
        if level < doc_level:
            alive = {i: _children(n, len(docs[level])) for i, n in alive.items()}
            doc_level = level
        left = {}
        for item, nodes in alive.items():
            used = items.used[item_level][item]
            bounds = docs[doc_level][np.ix_(nodes, used)] @ items.levels[item_level][item, used]
            stay = bounds >= weakest[item_level][item]
            nodes, bounds = nodes[stay], bounds[stay]
            if followed and doc_level and len(nodes) > followed:
                most = np.sort(np.argpartition(-bounds, followed)[:followed])
                nodes, bounds = nodes[most], bounds[most]
            if len(nodes) and level == 0:
                items.offer(item, bounds.astype(np.int64), ids[nodes])
            elif len(nodes):
                left[item] = nodes
        alive = left


PARSED = "_item bigint, item_id bigint, terms array<binary>, counts array<int>"
NO_ID = np.iinfo(np.int64).max


def _parsed(items: DataFrame) -> DataFrame:
    """Each item's distinct terms and their counts, under a number of its own."""
    import pyarrow as pa

    def parse(batches):
        for batch in batches:
            out = []
            for number, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts: dict[bytes, int] = {}
                for term in terms_of(text):
                    counts[term] = counts.get(term, 0) + 1
                out.append((number, item, list(counts), list(counts.values())))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_item", "item_id", "terms", "counts"])

    rows = items.select(
        F.monotonically_increasing_id().alias("_item"), F.col("item_id").cast("bigint"), F.col("text").cast("binary")
    )
    return rows.mapInArrow(parse, PARSED)


VECTORS = "doc_id bigint, words bigint, terms array<int>, counts array<int>"


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, the number of all its terms, and its counts of the vocabulary's terms; texts without a term go."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            ids, words, terms, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    known = np.fromiter(map(vocabulary.get, found, repeat(-1)), dtype=np.int32, count=len(found))
                    own, times = np.unique(known[known >= 0], return_counts=True)
                    ids.append(doc)
                    words.append(len(found))
                    terms.append(own)
                    counts.append(times.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *c]), pa.int32())) for c in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), *lists], ["doc_id", "words", "terms", "counts"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(count, VECTORS)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _ordered(vectors: DataFrame, documents: int, words: int, commonness: np.ndarray) -> DataFrame:
    """``doc_id, terms, parts`` of documents with a known term, those with the same rarest terms side by side."""
    import pyarrow as pa

    def score(batches):
        for batch in batches:
            ids, lengths = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes, terms = _lists(batch.column(2))
            _, counts = _lists(batch.column(3))
            m = 25 + (75 * lengths * documents) // words
            tf = counts.astype(np.int64)
            parts = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
            starts = np.cumsum(sizes) - sizes
            rank = commonness[terms]
            # the two rarest terms: the least rank, and the least once that one is out
            first = np.minimum.reduceat(np.r_[rank, 0], starts) if len(starts) else rank
            rest = np.where(rank == np.repeat(first, sizes), len(commonness), rank)
            second = np.minimum.reduceat(np.r_[rest, 0], starts) if len(starts) else rest
            ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(first, pa.int32()),
                    pa.array(second, pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(parts, pa.int64())),
                ],
                ["doc_id", "_first", "_second", "terms", "parts"],
            )

    scored = vectors.where(F.size("terms") > 0).mapInArrow(
        score, "doc_id bigint, _first int, _second int, terms array<int>, parts array<bigint>"
    )
    key = ["_first", "_second", "doc_id"]
    return scored.repartitionByRange(*key).sortWithinPartitions(*key).drop("_first", "_second")


def _search(ordered: DataFrame, weights: np.ndarray, floors: np.ndarray, k: int, followed: int | None) -> DataFrame:
    """``_at`` (an item of the block), ``score`` and ``doc_id`` (NO_ID for null): each task's best."""
    import pyarrow as pa

    together = max(FAN, CELLS // max(1, weights.shape[1]))

    def run(batches):
        items = ItemTree(weights, floors)
        items.k = k

        def settle(chunk: list[tuple]) -> None:
            parts = np.zeros((sum(len(c[0]) for c in chunk), weights.shape[1]), dtype=weights.dtype)
            at = 0
            for ids, sizes, terms, values in chunk:
                parts[np.repeat(np.arange(at, at + len(ids)), sizes), terms] = values
                at += len(ids)
            descend(items, parts, np.concatenate([c[0] for c in chunk]), followed)

        waiting, size = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes, terms = _lists(batch.column(1))
            _, values = _lists(batch.column(2))
            ends = np.r_[0, np.cumsum(sizes)]
            at = 0
            while at < len(ids):
                to = min(len(ids), at + together - size)
                waiting.append((ids[at:to], sizes[at:to], terms[ends[at] : ends[to]], values[ends[at] : ends[to]]))
                size, at = size + to - at, to
                if size == together:
                    settle(waiting)
                    waiting, size = [], 0
        if waiting:
            settle(waiting)
        numbers = np.repeat(items.order, [len(s) for s in items.scores])
        columns = [numbers, *(np.concatenate([np.empty(0, np.int64), *c]) for c in (items.scores, items.ids))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_at", "score", "doc_id"])

    return ordered.mapInArrow(run, "_at bigint, score bigint, doc_id bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The tasks' best merged: ``rank`` from 1 within ``_at``."""
    order = Window.partitionBy("_at").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"


def _one_block(spark: SparkSession, docs: DataFrame, block, k: int) -> DataFrame:
    """Ranks of one block of items, given as an Arrow table of PARSED rows."""
    vocabulary: dict[bytes, int] = {}
    entries = []
    for at, (terms, counts) in enumerate(zip(block["terms"].to_pylist(), block["counts"].to_pylist())):
        entries += [(at, vocabulary.setdefault(t, len(vocabulary)), c) for t, c in zip(terms, counts)]
    vectors = materialize(_vectors(docs, vocabulary), "vectors")
    documents, words = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary), dtype=np.int64)
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        holding[term] = n  # at most the block's terms
    idf = np.array([weight(documents, int(n)) for n in holding], dtype=np.int64)
    weights = np.zeros((block.num_rows, len(vocabulary)), dtype=np.int64)
    for at, term, count in entries:
        weights[at, term] = count * idf[term]
    if float(weights.max(axis=0).sum(dtype=np.float64)) * PART_BOUND < WHOLE:  # the root's weights bound every node's
        weights = weights.astype(np.float64)
    commonness = np.argsort(np.argsort(holding, kind="stable"), kind="stable").astype(np.int32)
    ordered = materialize(_ordered(vectors, documents, max(words, 1), commonness), "ordered")
    floors = np.ones(block.num_rows, dtype=np.int64)
    first = _best(_search(ordered, weights, floors, k, FOLLOWED), k).where(F.col("rank") == k)
    for at, score in first.select("_at", "score").collect():  # at most one row per item of the block
        floors[at] = max(1, score)
    found = _best(_search(ordered, weights, floors, k, None), k)
    names = spark.createDataFrame(
        list(enumerate(block["item_id"].to_pylist())), "_at bigint, item_id bigint"
    )
    return materialize(
        found.join(F.broadcast(names), "_at").select(
            "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"
        ),
        "ranked",
    )


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; other columns are not read. Texts without a term (null and empty ones too) neither
    count nor rank. Every row of ``docs`` ranks by itself, also if it repeats another; equal scores go by ascending doc_id, null last. Every
    row of ``items`` gets its own ranks; one without a term gets none. Empty tables give no rows. Terms, weights and scores
    are those of the contract in README.

    Items are taken in blocks of at most about CELLS (item, term) cells, each a pass over the documents; one block's terms, weights and
    kth scores are all that the driver and every task hold.
    """
    spark = docs.sparkSession
    parsed = materialize(_parsed(items), "items").where(F.size("terms") > 0)
    rows, entries = parsed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = math.ceil(math.sqrt(rows * entries / CELLS))
    out = []
    for b in range(blocks):
        block = parsed.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            out.append(_one_block(spark, docs, block, k))
    if not out:
        return spark.createDataFrame([], RESULT)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, r, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes),
asked AS (
  SELECT item_id, i, term, CAST(count(*) AS BIGINT) AS times
  FROM (SELECT item_id, i, unnest(terms) AS term
        FROM (SELECT item_id, row_number() OVER () AS i, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL))
  GROUP BY ALL),
held AS (
  SELECT doc_id, r, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, r, n, unnest(terms) AS term FROM sizes)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals GROUP BY term, docs),
scored AS (
  SELECT item_id, i, r, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item_id, i, r, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY i ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= {BEST}
"""


@query("op11_dual_tree_search", SQL)
def op11(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

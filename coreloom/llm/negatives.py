"""Hard negatives by exact integer inner products of anchors and all rows.

Anchors, a stated part of the rows, come in bounded blocks; every block meets all rows, which stream through
tasks in tiles. A tile of anchors times a tile of rows is one matrix product of 64-bit integers, done by
Strassen's recursion: an odd side is padded with a row or column of zeros, seven products of half the size replace eight,
and integer additions keep it exact. Rows lie sorted by label, so the first pass multiplies an anchor only with rows of its own label
(positives), the second only with those of other labels (negatives within the window that a positive's score opens). Both passes keep
bounded heaps per anchor, which are merged across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreloom.llm.registry import query, table
from coreloom.session import materialize

#: Components are scaled by this and rounded down.
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors of one pass over the rows, and about so many rows a task.
BLOCK = 8_192
ROWS_A_TASK = 32_768
TILE = 512
#: Sides up to this are multiplied plainly.
PLAIN = 32
#: Offers kept before a heap is put in order.
WAITING = 400_000
LOWEST = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` for 64-bit integers; right whenever the result's entries fit (sums may wrap on the way)."""
    n, k, m = *a.shape, b.shape[1]
    if min(n, k, m) <= PLAIN:
        return np.ascontiguousarray(a) @ np.ascontiguousarray(b)
    if n % 2 or k % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
    if k % 2 or m % 2:
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * h, 2 * j), dtype=np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """The ``k`` best (score, then smaller id, then smaller row) of each slot, as flat arrays."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.floor = np.full(slots, LOWEST)
        self.kept = [np.empty(0, dtype=np.int64)] * 4
        self.new: list[tuple] = []
        self.waiting = 0

    def offer(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offer a tile: row i of ``scores`` belongs to ``slots[i]``, column j is row ``rows[j]`` with id ``ids[j]``."""
        allowed = allowed & (scores >= self.floor[slots][:, None])
        if scores.shape[1] > self.k and allowed.any():
            at = scores.shape[1] - self.k
            cut = np.partition(np.where(allowed, scores, LOWEST), at, axis=1)[:, at]
            allowed &= scores >= cut[:, None]
        i, j = np.nonzero(allowed)
        if len(i):
            self.new.append((slots[i], scores[i, j], ids[j], rows[j]))
            self.waiting += len(i)
            if self.waiting > WAITING:
                self.settle()

    def settle(self) -> list[np.ndarray]:
        slot, score, ids, rows = (np.concatenate(parts) for parts in zip(self.kept, *self.new))
        order = np.lexsort((rows, ids, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, dtype=np.int64)
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        order = order[rank < self.k]
        self.kept = [slot[rank < self.k], score[order], ids[order], rows[order]]
        last = rank[rank < self.k] == self.k - 1
        self.floor[self.kept[0][last]] = self.kept[1][last]
        self.new, self.waiting = [], 0
        return self.kept


def _matrix(vectors, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers, shorter ones padded with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _ids(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _tiles(batches, width: int) -> Iterator[tuple]:
    """``label, ids, rows, vectors`` (one row a column) of every label in every batch, in tiles."""
    for batch in batches:
        ids, labels, rows = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), _ids(batch.column(3))
        vectors = _matrix(batch.column(2), width)
        for label in np.unique(labels):
            of = np.flatnonzero(labels == label)
            for at in range(0, len(of), 4 * TILE):
                some = of[at : at + 4 * TILE]
                yield label, ids[some], rows[some], np.ascontiguousarray(vectors[some].T)


OFFERED = "_anchor bigint, _window int, _score bigint, _id bigint, _other bigint"


def _scan(rows: DataFrame, block: dict[str, np.ndarray], k: int, windows: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Each task's best rows for each anchor of the block (``windows`` None: same label), or for each window of it."""
    import pyarrow as pa

    width = block["vectors"].shape[1]

    def run(batches):
        each = 1 if windows is None else windows[0].shape[1]
        heaps = Heaps(len(block["rows"]) * each, k)
        for label, ids, others, columns in _tiles(batches, width):
            match = block["labels"] == label
            anchors = np.flatnonzero(match if windows is None else ~match)
            for at in range(0, len(anchors), TILE):
                some = anchors[at : at + TILE]
                scores = strassen(block["vectors"][some], columns)
                if windows is None:
                    heaps.offer(some, scores, block["rows"][some][:, None] != others, ids, others)
                else:
                    for w in range(each):
                        low, high = windows[0][some, w][:, None], windows[1][some, w][:, None]
                        heaps.offer(some * each + w, scores, (scores >= low) & (scores <= high), ids, others)
        slot, score, ids, others = heaps.settle()
        for at in range(0, len(slot), 100_000):
            part = slice(at, at + 100_000)
            of = [block["rows"][slot[part] // each], slot[part] % each, score[part], ids[part], others[part]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == 1 else pa.int64()) for n, c in enumerate(of)],
                ["_anchor", "_window", "_score", "_id", "_other"],
            )

    return rows.mapInArrow(run, OFFERED)


def _merged(offers: DataFrame, k: int) -> DataFrame:
    """The tasks' heaps merged: the ``k`` best of each anchor and window, with ``_rank`` from 1."""
    order = Window.partitionBy("_anchor", "_window").orderBy(F.desc("_score"), "_id", "_other")
    return offers.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, vector`` (scaled integers) of the rows that take part.

    Rows with a null label, a null vector, or a null or non-finite component take none.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive of it.

    ``vectors`` has ``vec_id, label, vector`` (integers, no null but in vec_id); ``is_anchor`` speaks of these columns. Scores are inner products, higher ones
    first, then smaller vec_ids (null last); a shorter vector counts as padded with zeros. A row is never its own
    positive, but a row that repeats it is. An anchor's positives are the first rows of its label, its
    negatives those of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Repeated anchors give
    repeated results; other columns are not read; an empty table gives none. Components so large that a score times 100 might
    pass 64 bits raise an error.

    Work is anchors times rows. Each block of about BLOCK anchors is brought to the tasks, through the driver, and meets all rows twice.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // ROWS_A_TASK))
    spread = vectors.select("vec_id", "label", "vector").repartition(tasks).sortWithinPartitions("label", "vec_id")
    rows = materialize(spread.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    peak = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x).cast("double"))))
    top, width = rows.agg(peak, F.max(F.size("vector"))).first()
    if (top or 0.0) ** 2 * (width or 0) >= 2.0**56:
        raise ValueError("components are too large for 64-bit scores")
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    blocks = -(-anchors.count() // BLOCK)
    results = []
    for b in range(blocks):
        of = anchors.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not of.num_rows:
            continue
        block = {
            "labels": of["label"].to_numpy(),
            "rows": of["_row"].to_numpy(),
            "vectors": _matrix(of["vector"].combine_chunks(), width),
        }
        first = materialize(_merged(_scan(rows, block, positives, None), positives), "positives")
        lows = np.full((of.num_rows, positives), 1, dtype=np.int64)
        highs = np.zeros((of.num_rows, positives), dtype=np.int64)
        place = {int(r): i for i, r in enumerate(block["rows"])}
        for row, rank, score in first.select("_anchor", "_rank", "_score").toLocalIterator():  # at most BLOCK * positives
            lows[place[row], rank - 1], highs[place[row], rank - 1] = -(-low * score // 100), high * score // 100
        second = materialize(_merged(_scan(rows, block, negatives, (lows, highs)), negatives), "negatives")
        known = first.select(
            "_anchor",
            (F.col("_rank") - 1).alias("_window"),
            F.when(F.col("_id") != LAST, F.col("_id")).alias("positive_id"),
            F.col("_score").alias("positive_score"),
        )
        ids = anchors.select(F.col("_row").alias("_anchor"), F.col("vec_id").alias("anchor_id"))
        results.append(
            second.join(known, ["_anchor", "_window"]).join(ids, "_anchor").select(
                "anchor_id",
                "positive_id",
                F.col("_rank").alias("rank"),
                F.when(F.col("_id") != LAST, F.col("_id")).alias("negative_id"),
                "positive_score",
                F.col("_score").alias("negative_score"),
            )
        )
    if not results:
        ids = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return spark.createDataFrame([], ids)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


SQL = f"""
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
ranked AS (
  SELECT p.anchor_id, p.positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS place,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= {NEGATIVES}
"""


@query("op12_strassen_hard_negatives", SQL)
def op12(spark, sf_dir):
    vectors = prepared(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)

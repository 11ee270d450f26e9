"""Random forests whose rows, nodes and scores stay in tables.

Features are binned once, and equal points are combined; a point's weight in a tree is a Poisson draw for its copies. While
a node holds more points than one task should, its class counts by bin are summed by Spark and the node is divided.
The points of every node that is left, a cell, go to one task, which grows the rest of that tree there. No table
of nodes passes through the driver: it holds only the few nodes above the cells.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from coreloom.operators.bounded import small_rows
from coreloom.operators.features import MAX_FEATURES, to_long
from coreloom.session import materialize

BINS = 32
MAX_CLASSES = 100
#: Points of a cell, and bytes of binned rows in one group of a task.
CELL_POINTS = 100_000
GROUP_BYTES = 16 * 1024 * 1024
#: Class counts that a task keeps in one pass over the points, and (point, feature) entries in one step of a cell.
PASS_COUNTS = 8_000_000
STEP_ENTRIES = 1 << 18
#: Bytes of probabilities summed for one block of rows.
BLOCK_BYTES = 32 * 1024 * 1024
LEAST_GAIN = 1e-12


@dataclass
class Top:
    """The nodes of one tree above its cells; ``left`` and the node after it are the children, feature -1 has none."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    #: class shares of the nodes that end here; all other nodes without children are cells
    leaves: dict[int, list[float]]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int32), np.array(self.cut, np.uint8), np.array(self.left, np.int32)


@dataclass
class ForestModel:
    """A fitted forest: ``nodes`` has one row per tree and cell, the rest is small."""

    nodes: DataFrame
    cuts: list[list[float]]
    classes: int
    tops: list[Top]
    #: (tree, feature, gain) of the nodes above the cells
    gains: list[tuple[int, int, float]]

    @property
    def getNumTrees(self) -> int:
        return len(self.tops)

    @property
    def numFeatures(self) -> int:
        return len(self.cuts)

    def feature_importances(self) -> list[float]:
        """Gain times weight by feature, as shares of each tree, then of the forest."""
        spark = self.nodes.sparkSession
        inside = self.nodes.select("tree", F.posexplode("importance").alias("feature", "gain"))
        above = spark.createDataFrame(self.gains, "tree int, feature int, gain double")
        both = inside.unionByName(above).groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        totals = both.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
        shares = both.join(F.broadcast(totals), "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
        found = {r["feature"]: r["share"] for r in small_rows(shares, MAX_FEATURES, "features")}
        total = sum(found.values()) or 1.0
        return [found.get(i, 0.0) / total for i in range(len(self.cuts))]

    def write(self) -> "_Writer":
        return _Writer(self)

    @staticmethod
    def load(path: str) -> "ForestModel":
        spark = SparkSession.active()
        told = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()["value"])
        tops = [Top(t["feature"], t["cut"], t["left"], {int(n): p for n, p in t["leaves"].items()}) for t in told["tops"]]
        gains = [(t, f, g) for t, f, g in told["gains"]]
        return ForestModel(spark.read.schema(NODES).parquet(f"{path}/nodes"), told["cuts"], told["classes"], tops, gains)


class _Writer:
    def __init__(self, model: ForestModel):
        self.model, self.mode = model, "errorifexists"

    def overwrite(self) -> "_Writer":
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        model = self.model
        tops = [vars(t) for t in model.tops]
        about = json.dumps({"cuts": model.cuts, "classes": model.classes, "tops": tops, "gains": model.gains})
        model.nodes.write.mode(self.mode).parquet(f"{path}/nodes")
        spark = model.nodes.sparkSession
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode(self.mode).text(f"{path}/about")


NODES = "tree int, cell int, feature binary, cut binary, left binary, shares binary, importance array<double>"
_NODES = pa.schema(
    [("tree", pa.int32()), ("cell", pa.int32()), *[(c, pa.binary()) for c in ("feature", "cut", "left", "shares")], ("importance", pa.list_(pa.float64()))]
)


def find_cuts(df: DataFrame) -> list[list[float]]:
    """Per feature at most BINS - 1 cuts; a value belongs to the bin numbered by the cuts below it.

    Up to BINS different values are told apart by the middles between them; more are cut at their quantiles.
    """
    long = to_long(df)
    at = [i / BINS for i in range(1, BINS)]
    told = long.groupBy("feature").agg(
        F.percentile_approx("x", at, 10_000).alias("at"), F.max("x").alias("high"), F.approx_count_distinct("x").alias("kinds")
    )
    rows = sorted(small_rows(told, MAX_FEATURES, "features"), key=lambda r: r["feature"])
    few = [r["feature"] for r in rows if r["kinds"] <= 2 * BINS]
    seen = {}
    if few:
        sets = long.where(F.col("feature").isin(few)).groupBy("feature").agg(F.collect_set("x").alias("seen"))
        seen = {r["feature"]: sorted(v for v in r["seen"] if v == v) for r in small_rows(sets, MAX_FEATURES, "features")}
    cuts = []
    for r in rows:
        values = seen.get(r["feature"])
        if values is not None and len(values) <= BINS:
            cuts.append([a + (b - a) / 2 for a, b in zip(values, values[1:])])
        else:
            cuts.append(sorted({v for v in r["at"] or [] if v == v and v != r["high"]}))
    return cuts


def _binned(features: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    cells = features.flatten()
    lengths = features.value_lengths().to_numpy(zero_copy_only=False)
    if features.null_count or cells.null_count or (lengths != len(cuts)).any():
        raise ValueError(f"a row has not {len(cuts)} known features")
    x = cells.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(cuts))
    found = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        found[:, f] = np.searchsorted(c, x[:, f])
    return found


def _matrix(blobs: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, width)


def descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node without children that each row ends in."""
    node = np.zeros(len(bins), np.int64)
    if not len(bins) or feature[0] < 0:
        return node
    flat, rows, at = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)), node
    first = rows * bins.shape[1]
    while len(rows):
        at = left.take(at) + (flat.take(first + feature.take(at)) > cut.take(at))
        inner = feature.take(at) >= 0
        if not inner.all():
            node[rows[~inner]] = at[~inner]
            rows, first, at = rows[inner], first[inner], at[inner]
    return node


def _impure(weights: np.ndarray, impurity: str) -> np.ndarray:
    """Impurity times weight, of rows of class weights."""
    total = weights.sum(axis=1)
    if impurity == "gini":
        return total - (weights * weights).sum(axis=1) / np.maximum(total, 1e-300)
    logs = weights * np.log2(np.maximum(weights, 1e-300))
    return total * np.log2(np.maximum(total, 1e-300)) - logs.sum(axis=1)


def best_splits(
    node: np.ndarray, slot: np.ndarray, counts: np.ndarray, nodes: int, weight: np.ndarray, impurity: str, min_leaf: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per node the row after which it is divided (-1: nowhere) and the gain times weight.

    Rows are the class counts of the bins that hold points, in order of node, slot and bin.
    """
    best, gain = np.full(nodes, -1), np.zeros(nodes)
    starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (slot[1:] != slot[:-1])])
    sizes = np.diff(np.r_[starts, len(node)])
    total = np.add.reduceat(counts, starts, axis=0)
    left = np.cumsum(counts, axis=0)
    left -= np.repeat(left[starts] - counts[starts], sizes, axis=0)
    group = np.repeat(np.arange(len(starts)), sizes)
    lower, whole = left.sum(axis=1), total.sum(axis=1)
    least = max(1, min_leaf)
    fine = np.flatnonzero((lower >= least) & (whole[group] - lower >= least))
    if not len(fine):
        return best, gain
    group, left = group[fine], left[fine]
    right = (total[group] - left) * weight
    total = total * weight
    found = _impure(total, impurity)[group] - _impure(left * weight, impurity) - _impure(right, impurity)
    found[found <= LEAST_GAIN * total.sum(axis=1)[group]] = 0.0
    at = node[fine]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    highest = np.maximum.reduceat(found, first)
    hit = np.flatnonzero((found == np.repeat(highest, np.diff(np.r_[first, len(at)]))) & (found > 0))
    where, once = np.unique(at[hit], return_index=True)
    best[where], gain[where] = fine[hit[once]], found[hit[once]]
    return best, gain


def _generator(*numbers: int) -> np.random.Generator:
    return np.random.default_rng([n & 0xFFFFFFFF for n in numbers])


def _subset(width: int) -> int:
    return math.ceil(math.sqrt(width))


def _choose(rng: np.random.Generator, nodes: int, width: int) -> np.ndarray:
    """The features that each node may be divided by."""
    return np.argpartition(rng.random((nodes, width)), _subset(width) - 1, axis=1)[:, : _subset(width)]


def grow(bins: np.ndarray, labels: np.ndarray, copies: np.ndarray, depth: int, classes: int, weight: np.ndarray, forest, rng) -> dict:
    """The rest of a tree from the points of one cell, level by level; ``depth`` levels may follow."""
    width, wanted = bins.shape[1], _subset(bins.shape[1])
    rows, node, active = np.arange(len(bins)), np.zeros(len(bins), np.int64), 1
    features, cuts, lefts, leaves, importance = [], [], [], [], np.zeros(width)
    made = 1
    step = max(1, min(STEP_ENTRIES, 8 * STEP_ENTRIES // classes) // wanted)
    while True:
        found = np.bincount(node * classes + labels[rows], weights=copies[rows], minlength=active * classes).reshape(active, classes)
        feature, cut, left = np.full(active, -1, np.int32), np.zeros(active, np.uint8), np.zeros(active, np.int32)
        mixed = ((found > 0).sum(axis=1) > 1) & (found.sum(axis=1) >= 2 * forest.min_leaf) & (depth > 0)
        open_rows = mixed[node]
        rows, node = rows[open_rows], node[open_rows]
        ends = np.searchsorted(node, np.arange(active), side="right")
        first = 0
        while first < active and len(rows):
            start = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + step, side="right")))
            last = min(last, first + max(1, 4 * STEP_ENTRIES // width))
            mine = slice(start, ends[last - 1])
            if mine.stop > mine.start:
                _divide(bins, labels, copies, rows[mine], node[mine] - first, last - first, classes, weight, forest, rng, slice(first, last), feature, cut, importance)
            first = last
        split = feature >= 0
        left[split] = made + 2 * np.arange(split.sum())
        features.append(feature), cuts.append(cut), lefts.append(left), leaves.append(found[~split])
        if not split.any():
            break
        kept = split[node]
        rows, node = rows[kept], node[kept]
        node = left[node] - made + (bins[rows, feature[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        rows, node, active = rows[order], node[order], 2 * int(split.sum())
        made, depth = made + active, depth - 1
    shares = np.concatenate(leaves) * weight
    shares /= shares.sum(axis=1, keepdims=True)
    arrays = {"feature": features, "cut": cuts, "left": lefts}
    return {**{n: np.concatenate(a).tobytes() for n, a in arrays.items()}, "shares": shares.tobytes(), "importance": importance.tolist()}


def _divide(bins, labels, copies, rows, node, nodes, classes, weight, forest, rng, at, feature, cut, importance) -> None:
    """Find the splits of some nodes of one level, and put them into ``feature`` and ``cut``."""
    wanted = _subset(bins.shape[1])
    chosen = _choose(rng, nodes, bins.shape[1])
    mine = bins[rows[:, None], chosen[node]]
    key = ((node[:, None] * wanted + np.arange(wanted)) * BINS + mine).ravel()
    if nodes * wanted * BINS <= 4 * len(key):
        held = np.bincount(key, minlength=nodes * wanted * BINS) > 0
        cells, place = np.flatnonzero(held), (np.cumsum(held) - 1)[key]
    else:
        cells, place = np.unique(key, return_inverse=True)
    spread = place * classes + np.repeat(labels[rows], wanted)
    counts = np.bincount(spread, weights=np.repeat(copies[rows], wanted), minlength=len(cells) * classes).reshape(-1, classes)
    owner, slot = cells // (wanted * BINS), cells // BINS % wanted
    best, gain = best_splits(owner, slot, counts, nodes, weight, forest.impurity, forest.min_leaf)
    hit = np.flatnonzero(best >= 0)
    feature[at][hit], cut[at][hit] = chosen[hit, slot[best[hit]]], cells[best[hit]] % BINS
    np.add.at(importance, chosen[hit, slot[best[hit]]], gain[hit])


def _bags(ids: np.ndarray, copies: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each tree draws each point: the sum of a Poisson draw per copy, fixed by the point and the seed."""
    found = np.empty((len(ids), trees), np.int64)
    bits = np.random.Philox(key=(seed & 0xFFFFFFFF) << 64)
    chance, state = np.random.Generator(bits), bits.state
    # one generator is set back to the start of each point's own stream: a new one costs far more than the draws
    key = np.array(state["state"]["key"], np.uint64)
    state["state"]["key"] = key
    for i, (low, n) in enumerate(zip(np.ascontiguousarray(ids).view(np.uint64), copies.tolist())):
        key[0] = low
        bits.state = state
        found[i] = chance.poisson(n, trees)
    return found


def fit(df: DataFrame, forest, label: str = "label") -> ForestModel:
    """Fit on ``features`` arrays and class codes 0..C-1."""
    cuts = find_cuts(df)
    if not cuts:
        raise ValueError("no features to fit a forest on")
    width, told = len(cuts), [np.array(c) for c in cuts]

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _binned(batch.column("features"), told)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), batch.column("label")], ["bins", "label"])

    code = F.col(label).cast("double")
    bad = code.isNull() | (code < 0) | (code != F.floor(code)) | (code >= MAX_CLASSES)
    code = F.when(bad, F.raise_error(F.lit(f"labels must be whole numbers from 0 to {MAX_CLASSES - 1}")).cast("int")).otherwise(code.cast("int"))
    binned = df.select("features", code.alias("label")).mapInArrow(bin_rows, "bins binary, label int")
    combined = binned.groupBy("bins", "label").agg(F.count(F.lit(1)).alias("copies"))
    points = materialize(combined.withColumn("id", F.xxhash64("bins", "label")), "points")
    sizes = {r["label"]: (r["rows"], r["points"]) for r in small_rows(
        points.groupBy("label").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("points")), MAX_CLASSES, "classes")}
    classes, rows, count = max(sizes) + 1, sum(n for n, _ in sizes.values()), sum(n for _, n in sizes.values())
    weight = np.zeros(classes)
    for c, (n, _) in sizes.items():
        weight[c] = rows / (len(sizes) * n) if forest.balanced else 1.0
    tops, gains, depths = _top(points, forest, width, classes, weight, count)
    above = [t.arrays() for t in tops]
    ends = [set(t.leaves) for t in tops]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, labels = _matrix(batch.column("bins"), width), batch.column("label").to_numpy().astype(np.int32)
            bags = _bags(batch.column("id").to_numpy(), batch.column("copies").to_numpy(), forest.trees, forest.seed)
            for tree, nodes in enumerate(above):
                drawn = np.flatnonzero(bags[:, tree])
                cell = descend(bins[drawn], *nodes)
                out = []
                for c in np.unique(cell):
                    mine = drawn[cell == c]
                    if len(mine) and int(c) not in ends[tree]:
                        out.append((tree, int(c), bins[mine].tobytes(), labels[mine].tobytes(), bags[mine, tree].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), _DEALT)], ["tree", "cell", "bins", "labels", "copies"])

    def grown(table: pa.Table) -> pa.Table:
        tree, cell = table.column("tree")[0].as_py(), table.column("cell")[0].as_py()
        labels = np.frombuffer(b"".join(table.column("labels").to_pylist()), np.int32)
        copies = np.frombuffer(b"".join(table.column("copies").to_pylist()), np.int64)
        rest = max(0, forest.depth - depths[tree].get(cell, 0))
        rng = _generator(forest.seed, tree, cell)
        found = grow(_matrix(table.column("bins"), width), labels, copies, rest, classes, weight, forest, rng)
        return pa.Table.from_pylist([{"tree": tree, "cell": cell, **found}], _NODES)

    dealt = _spread(points).mapInArrow(deal, "tree int, cell int, bins binary, labels binary, copies binary")
    tasks = _tasks(points.sparkSession, sum(len(d) for d in depths))
    nodes = dealt.repartition(tasks, "tree", "cell").groupBy("tree", "cell").applyInArrow(grown, NODES)
    return ForestModel(materialize(nodes, "forest"), cuts, classes, tops, gains)


_DEALT = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _tasks(spark: SparkSession, groups: int) -> int:
    """Some tasks a core, and no more than about eight groups a task."""
    return max(1, min(groups, max(4 * spark.sparkContext.defaultParallelism, math.ceil(groups / 8))))


def _spread(points: DataFrame, key: str = "id") -> DataFrame:
    """The points by ``key`` over all cores, also where they are few bytes."""
    return points.repartition(2 * points.sparkSession.sparkContext.defaultParallelism, key)


def _top(points: DataFrame, forest, width: int, classes: int, weight: np.ndarray, count: int):
    """The nodes of all trees that hold more points than a cell; also their gains, and the depth of every node without children."""
    limit = max(1, min(CELL_POINTS, GROUP_BYTES // width))
    wanted = _subset(width)
    tops = [Top([-1], [0], [0], {}) for _ in range(forest.trees)]
    depths: list[dict[int, int]] = [{0: 0} for _ in tops]
    gains: list[tuple[int, int, float]] = []
    waiting = [(t, 0) for t in range(forest.trees)] if count > limit and forest.depth > 0 else []
    if waiting:
        points = materialize(_spread(points), "points")
    while waiting:
        many = max(1, PASS_COUNTS // (wanted * BINS * classes))
        mine, waiting = waiting[:many], waiting[many:]
        chosen = {(t, n): _choose(_generator(forest.seed, t, n, 1), 1, width)[0] for t, n in mine}
        for r in _summed(points, forest, width, classes, weight, tops, chosen).toLocalIterator():
            tree, node, top = r["tree"], r["node"], tops[r["tree"]]
            depth = depths[tree][node]
            sides = [(r["left"], r["left_points"]), (r["right"], r["right_points"])]
            if r["feature"] is None:
                if r["left_points"] > limit:
                    top.leaves[node] = _shares(r["left"], weight)
                continue
            place = len(top.feature)
            top.feature[node], top.cut[node], top.left[node] = r["feature"], r["cut"], place
            gains.append((tree, r["feature"], r["gain"]))
            depths[tree].pop(node)
            for child, (counts, held) in enumerate(sides, place):
                top.feature.append(-1), top.cut.append(0), top.left.append(0)
                depths[tree][child] = depth + 1
                if held > limit:
                    done = depth + 1 >= forest.depth or sum(c > 0 for c in counts) < 2 or sum(counts) < 2 * forest.min_leaf
                    if done:
                        top.leaves[child] = _shares(counts, weight)
                    else:
                        waiting.append((tree, child))
    return tops, sorted(gains), depths


def _shares(counts: list[float], weight: np.ndarray) -> list[float]:
    shares = np.array(counts) * weight
    return (shares / shares.sum()).tolist()


_SUMS = "tree int, node int, cell int, label int, n bigint, points bigint"
_BEST = (
    "tree int, node int, feature int, cut int, gain double, left array<double>, right array<double>, left_points bigint, right_points bigint"
)


def _summed(points: DataFrame, forest, width: int, classes: int, weight: np.ndarray, tops: list[Top], chosen: dict) -> DataFrame:
    """The best split of every node in ``chosen``, from class counts by bin that Spark sums over the points.

    Without a split, ``feature`` is null and the left side is the whole node.
    """
    wanted = _subset(width)
    above = {t: tops[t].arrays() for t, _ in chosen}
    number = {}
    for t, n in chosen:
        number.setdefault(t, {})[n] = len(number.setdefault(t, {}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = wanted * BINS * classes
        sums = {t: np.zeros((2, len(nodes) * size)) for t, nodes in number.items()}
        for batch in batches:
            bins, labels = _matrix(batch.column("bins"), width), batch.column("label").to_numpy().astype(np.int64)
            bags = _bags(batch.column("id").to_numpy(), batch.column("copies").to_numpy(), forest.trees, forest.seed)
            for t, nodes in number.items():
                drawn = np.flatnonzero(bags[:, t])
                place = descend(bins[drawn], *above[t])
                order = np.full(len(above[t][0]), -1)
                order[list(nodes)] = list(nodes.values())
                at = order[place]
                drawn, at = drawn[at >= 0], at[at >= 0]
                subsets = np.array([chosen[t, n] for n in nodes])
                key = (at[:, None] * wanted + np.arange(wanted)) * BINS + bins[drawn[:, None], subsets[at]]
                key = (key * classes + labels[drawn][:, None]).ravel()
                sums[t][0] += np.bincount(key, weights=np.repeat(bags[drawn, t], wanted), minlength=sums[t].shape[1])
                sums[t][1] += np.bincount(key, minlength=sums[t].shape[1])
        for t, nodes in number.items():
            held, names = np.flatnonzero(sums[t][1]), np.array(list(nodes), np.int32)
            yield pa.RecordBatch.from_pydict({
                "tree": np.full(len(held), t, np.int32), "node": names[held // size], "cell": (held % size // classes).astype(np.int32),
                "label": (held % classes).astype(np.int32), "n": sums[t][0][held].astype(np.int64), "points": sums[t][1][held].astype(np.int64),
            })

    def best(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        cell, label, n, held = (table.column(c).to_numpy() for c in ("cell", "label", "n", "points"))
        cells, place = np.unique(cell, return_inverse=True)
        spread = place * classes + label
        counts = np.bincount(spread, weights=n, minlength=len(cells) * classes).reshape(-1, classes)
        members = np.bincount(place, weights=held, minlength=len(cells))
        slot = cells // BINS
        row, gain = best_splits(np.zeros(len(cells), np.int64), slot, counts, 1, weight, forest.impurity, forest.min_leaf)
        own = slot == (slot[row[0]] if row[0] >= 0 else 0)
        lower = own & (cells <= cells[row[0]]) if row[0] >= 0 else own
        out = {"tree": tree, "node": node, "gain": float(gain[0])}
        if row[0] >= 0:
            out |= {"feature": int(chosen[tree, node][slot[row[0]]]), "cut": int(cells[row[0]] % BINS)}
        for name, side in (("left", lower), ("right", own & ~lower)):
            out |= {name: counts[side].sum(axis=0).tolist(), f"{name}_points": int(members[side].sum())}
        return pa.Table.from_pylist([out], _BEST_ARROW)

    sums = points.mapInArrow(count, _SUMS).groupBy("tree", "node", "cell", "label").agg(F.sum("n").alias("n"), F.sum("points").alias("points"))
    return sums.groupBy("tree", "node").applyInArrow(best, _BEST)


_BEST_ARROW = pa.schema(
    [("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64())]
    + [(c, pa.list_(pa.float64())) for c in ("left", "right")]
    + [(c, pa.int64()) for c in ("left_points", "right_points")]
)


def score(model: ForestModel, df: DataFrame) -> DataFrame:
    """Add ``probability``, the mean of the trees' class shares, and ``prediction``, the first class of the largest one.

    Rows of equal bins are scored once. They go, by blocks, to the cells they end in, and the shares of a block come back
    together; a task holds the rows of one group and the nodes of one cell.
    """
    width, classes, trees = len(model.cuts), model.classes, len(model.tops)
    cuts = [np.array(c) for c in model.cuts]
    bits = max(6, min(13, int(math.log2(max(1, BLOCK_BYTES // (trees * (classes * 8 + 4)))))))

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _binned(batch.column("features"), cuts)
            yield batch.append_column("_bins", pa.array([r.tobytes() for r in found], pa.binary()))

    rows = materialize(df.mapInArrow(bin_rows, StructType([*df.schema.fields, StructField("_bins", BinaryType())])), "scored")
    points = materialize(_spread(rows.select("_bins").distinct(), "_bins").withColumn("_row", F.monotonically_increasing_id()), "different")
    count = points.count()
    parts = max(1, math.ceil(count / max(1_000, GROUP_BYTES // (width + 8))))
    above = [t.arrays() for t in model.tops]
    ends = [{n: np.array(p) for n, p in t.leaves.items()} for t in model.tops]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ids = _matrix(batch.column("_bins"), width), batch.column("_row").to_numpy()
            block, slot = ids >> bits, (ids & ((1 << bits) - 1)).astype(np.int32)
            for b in np.unique(block):
                inside = np.flatnonzero(block == b)
                mine, at = bins[inside], slot[inside]
                out = []
                for tree, nodes in enumerate(above):
                    cell = descend(mine, *nodes)
                    for c in np.unique(cell).tolist():
                        own = cell == c
                        found = np.repeat(ends[tree][c][None], own.sum(), axis=0).tobytes() if c in ends[tree] else None
                        out.append((tree, c, int(b) % parts, int(b), at[own].tobytes(), None if found else mine[own].tobytes(), found))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), _ROUTED_ARROW)], _ROUTED_NAMES)

    def reached(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], _REACHED_ARROW)
        shares = left.column("found").to_pylist()
        if right.num_rows:
            nodes = right.slice(0, 1).to_pylist()[0]
            feature, cut, child = (np.frombuffer(nodes[c], t) for c, t in (("feature", np.int32), ("cut", np.uint8), ("left", np.int32)))
            leaf, table = np.cumsum(feature < 0) - 1, np.frombuffer(nodes["shares"]).reshape(-1, classes)
            # all rows of the group go down at once; its blocks take their own part of the shares
            at = leaf[descend(_matrix(left.column("bins"), width), feature, cut, child)]
            ends_at = np.cumsum([len(b) // width for b in left.column("bins").to_pylist()])
            shares = [table[a].tobytes() for a in np.split(at, ends_at[:-1])]
        elif left.column("found").null_count:
            shares = [None] * left.num_rows  # a cell that no point of its tree was drawn for
        columns = [left.column("block"), left.column("tree"), left.column("cell"), left.column("slots"), pa.array(shares, pa.binary())]
        return pa.Table.from_arrays(columns, schema=_REACHED_ARROW)

    def summed(table: pa.Table) -> pa.Table:
        total, seen = np.zeros((1 << bits, classes)), np.zeros(1 << bits, bool)
        for r in table.sort_by([("tree", "ascending"), ("cell", "ascending")]).select(["slots", "shares"]).to_pylist():
            at = np.frombuffer(r["slots"], np.int32)
            seen[at] = True
            if r["shares"] is not None:
                total[at] += np.frombuffer(r["shares"]).reshape(-1, classes)
        at = np.flatnonzero(seen)
        found = total[at]
        found /= np.maximum(found.sum(axis=1, keepdims=True), 1e-300)
        block = table.column("block")[0].as_py()
        values = pa.array(found.ravel())
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * classes)
        columns = [pa.array((block << bits) + at, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(found.argmax(axis=1).astype(np.int32))]
        return pa.Table.from_arrays(columns, names=["_row", "probability", "prediction"])

    groups = sum(t.feature.count(-1) for t in model.tops) * parts
    tasks = _tasks(df.sparkSession, groups)
    routed = points.mapInArrow(route, _ROUTED).repartition(tasks, "tree", "cell", "part")
    copies = model.nodes.drop("importance").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "tree", "cell", "part")
    on = ["tree", "cell", "part"]
    found = routed.groupBy(*on).cogroup(copies.groupBy(*on)).applyInArrow(reached, _REACHED)
    scored = found.groupBy("block").applyInArrow(summed, "_row bigint, probability array<double>, prediction int")
    # both sides grow with the rows: never a broadcast, which the driver would hold
    by_bins = points.hint("merge").join(scored, "_row").drop("_row")
    return rows.hint("merge").join(by_bins, "_bins").drop("_bins")


_ROUTED = "tree int, cell int, part int, block bigint, slots binary, bins binary, found binary"
_ROUTED_NAMES = ["tree", "cell", "part", "block", "slots", "bins", "found"]
_ROUTED_ARROW = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_REACHED = "block bigint, tree int, cell int, slots binary, shares binary"
_REACHED_ARROW = pa.schema([("block", pa.int64()), ("tree", pa.int32()), ("cell", pa.int32()), ("slots", pa.binary()), ("shares", pa.binary())])

"""The steps of nested clusters below a cell that one task can hold: the same ones that larger cells take as Spark jobs.

A missing value (null) makes a distance unknown; unknown distances are passed over, and a row without a known one has no
slot (-1 here). NaN is larger than any other distance. All of this is as Spark's functions have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

#: Rows whose distances are computed together.
TOGETHER = 4096
#: Columns that the rows bring besides those of the caller.
GIVEN = ("cell", "_hash", "_quota", "_level")


def hashed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Spark's xxhash64 of a value and an integer, from that of the value."""
    one, two, three, five = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    mask = (1 << 64) - 1
    h = hashes.view(np.uint64) + np.uint64((five + 4) & mask)
    h ^= np.uint64((seed & 0xFFFFFFFF) * one & mask)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * np.uint64(two) + np.uint64(three)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(two)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(three)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def matrix(features: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """A column of arrays as rows of ``width`` numbers, and which of them are missing (None if none are)."""
    lists = features.combine_chunks()
    flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not flat.null_count and not lists.null_count and (sizes == width).all():
        return flat.to_numpy(zero_copy_only=False).reshape(len(lists), width), None
    x, missing = np.zeros((len(lists), width)), np.ones((len(lists), width), dtype=bool)
    row = np.repeat(np.arange(len(lists)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[row, at] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    missing[row, at] = flat.is_null().to_numpy(zero_copy_only=False)
    return x, missing


def parts_of(quota: int, fan: int) -> int:
    depth = math.ceil(math.log(quota) / math.log(fan) - 1e-9)
    return max(2, min(fan, math.ceil(quota ** (1.0 / depth) - 1e-9)))


def shared(quota: int, sizes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """A divided cell's quota by largest remainder, one for each part at least, and one for a part of equal rows."""
    extra = quota - len(sizes)
    exact = (extra * sizes) / sizes.sum()
    base = np.floor(exact).astype(np.int64)
    quotas = 1 + base
    quotas[np.lexsort((np.arange(len(sizes)), base - exact))[: extra - base.sum()]] += 1
    return np.where(points, 1, np.minimum(quotas, sizes))


class Cells:
    """A task's rows, and the Lloyd steps inside cells of them."""

    def __init__(self, features: pa.ChunkedArray, hashes: pa.ChunkedArray | None, width: int, fan: int, seed: int):
        self.x, self.missing = matrix(features, width)
        self.hashes = None if hashes is None else hashes.to_numpy()
        self.width, self.fan, self.seed = width, fan, seed

    def one_point(self, rows: np.ndarray) -> bool:
        x = self.x[rows]
        same = (x == x[0]) | (np.isnan(x) & np.isnan(x[0]))
        if self.missing is not None:
            missing = self.missing[rows]
            same = (same & ~missing & ~missing[0]) | (missing & missing[0])
        return bool(same.all())

    def first(self, rows: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, ...]:
        """Slots, centres and their missing values: of the rows that a hash deals to a slot, the one of lowest hash."""
        hashes = self.hashes[rows]
        slot, order = hashed(hashes, seed) % parts, hashed(hashes, seed + 1)
        ranked = np.lexsort((order, slot))
        slots, at = np.unique(slot[ranked], return_index=True)
        chosen = rows[ranked[at]]
        return slots, self.x[chosen], None if self.missing is None else self.missing[chosen]

    def totals(self, rows: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Slots that have rows, and each one's sums of the known values of a feature and their number; no slot counts as one."""
        counts = np.bincount(slot + 1, minlength=self.fan + 1)
        used = np.flatnonzero(counts)
        sums, numbers = np.empty((len(used), self.width)), np.empty((len(used), self.width))
        for f in range(self.width):
            x, known = self.x[rows, f], counts
            if self.missing is not None:
                there = (~self.missing[rows, f]).astype(np.float64)
                x, known = np.where(there > 0, x, 0.0), np.bincount(slot + 1, weights=there, minlength=self.fan + 1)
            sums[:, f] = np.bincount(slot + 1, weights=x, minlength=self.fan + 1)[used]
            numbers[:, f] = known[used]
        return used - 1, sums, numbers

    def means(self, rows: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Slots, means of their rows, and which means are missing."""
        slots, sums, known = self.totals(rows, slot)
        return slots, sums / np.maximum(known, 1), known == 0 if self.missing is not None else None

    def assign(self, rows: np.ndarray, slots: np.ndarray, centers: np.ndarray, gone: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Each row's slot and distance, the lowest slot on equal distance."""
        slots, centers = slots[: self.fan], centers[: self.fan]
        columns = np.ascontiguousarray(centers.T)
        slot, distance = np.empty(len(rows), dtype=np.int64), np.empty(len(rows))
        for at in range(0, len(rows), TOGETHER):
            some = rows[at : at + TOGETHER]
            x = self.x[some]
            squares = np.zeros((len(some), len(slots)))
            with np.errstate(invalid="ignore", over="ignore"):
                for f in range(self.width):
                    gaps = x[:, f, None] - columns[f]
                    gaps *= gaps
                    squares += gaps
            nearest = squares.argmin(axis=1)
            least = squares[np.arange(len(some)), nearest]
            chosen = slots[nearest]
            if self.missing is not None or not np.isfinite(least).all():
                chosen, least = self._odd(some, x, squares, slots, None if gone is None else gone[: self.fan])
            slot[at : at + TOGETHER], distance[at : at + TOGETHER] = chosen, least
        with np.errstate(invalid="ignore"):
            return slot, np.sqrt(distance)

    def _odd(self, rows: np.ndarray, x: np.ndarray, squares: np.ndarray, slots: np.ndarray, gone: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Slots and squared distances where values may be missing, NaN or infinite; an unknown distance is -1 (its root is NaN)."""
        known = np.ones(squares.shape, dtype=bool)
        lost = np.zeros(len(rows), dtype=bool)
        if self.missing is not None:
            lost = self.missing[rows].any(axis=1)
            known &= ~gone.any(axis=1)
        known &= ~lost[:, None]
        nan = np.isnan(squares)
        usable = known & ~nan
        least = np.where(usable, squares, np.inf).min(axis=1)
        at = (usable & (squares == least[:, None])).argmax(axis=1)
        slot = np.where(usable.any(axis=1), slots[at], -1)
        # missing centres, up to the fan, lie infinitely far away
        far = len(slots) < self.fan and ~(np.isnan(x) | (x == np.inf)).any(axis=1)
        worst = ~usable.any(axis=1) & ~lost & ~far & known.any(axis=1)
        slot = np.where(worst, slots[(known & nan).argmax(axis=1)], slot)
        least = np.where(worst, np.nan, least)
        unknown = lost | (~known.any(axis=1) & ~far)
        return np.where(unknown, -1, slot), np.where(unknown, -1.0, least)

    def lloyd(self, rows: np.ndarray, parts: int, rounds: int, seed: int) -> tuple[np.ndarray, ...]:
        """Slots and distances of ``rows`` after some steps, and the centres' slots, values and missing values."""
        found = self.first(rows, parts, seed)
        for _ in range(rounds):
            found = self.means(rows, self.assign(rows, *found)[0])
        return *self.assign(rows, *found), *found

    def leaves(self, cell: int, quota: int, level: int, rounds: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """``(cell, quota, level, rows)`` of the cells below ``cell`` whose quota is the fan at most."""
        left = [(cell, quota, level, np.arange(len(self.x)))]
        while left:
            cell, quota, level, rows = left.pop()
            if quota <= self.fan:
                yield cell, quota, level, rows
                continue
            slot = self.lloyd(rows, parts_of(quota, self.fan), rounds, self.seed + level)[0]
            order = np.argsort(slot, kind="stable")
            slots, starts = np.unique(slot[order], return_index=True)
            below = [(int(s), rows[part]) for s, part in zip(slots, np.split(order, starts[1:])) if s >= 0]
            if not below:
                continue
            sizes, points = np.array([len(r) for _, r in below]), np.array([self.one_point(r) for _, r in below])
            for (s, r), q in zip(below, shared(quota, sizes, points).tolist()):
                left.append((cell * self.fan + s + 1, q, level + 1, r))


def _near(table: pa.Table, width: int) -> dict[int, tuple]:
    """By cell the slots, values and missing values of its centres (cell, slot, center), in the order of slots."""
    cell = table.column("cell").to_numpy()
    slots = table.column("slot").fill_null(-1).to_numpy().astype(np.int64)
    values, gone = matrix(table.column("center"), width)
    order = np.lexsort((slots, cell))
    parts = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []
    return {int(cell[own[0]]): (slots[own], values[own], None if gone is None else gone[own]) for own in parts}


def with_nearest(rows: DataFrame, centers: pa.Table | None, width: int, fan: int, summed: bool = False) -> DataFrame:
    """Rows with the ``slot`` and ``distance`` of the nearest of their cell's ``centers`` (else of ``_near``, which rows bring).

    For cells that no task holds; a task takes a batch's rows of a cell together. ``summed`` gives instead, per
    batch, ``cell, slot``, and the ``sums`` of the known values of each feature and how many are ``known``.
    """
    kept = [c for c in rows.columns if c != "_near"]
    fields = [StructField(f.name, f.dataType, True) for f in rows.schema if f.name in kept]
    given = None if centers is None else _near(centers, width)

    def listed(near: pa.StructArray) -> tuple:
        return _near(pa.table({"cell": pa.array(np.zeros(len(near), dtype=np.int64)), "slot": near.field("slot"), "center": near.field("center")}), width)[0]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            features = pa.chunked_array([batch.column("features").cast(pa.list_(pa.float64()))])
            cells = Cells(features, None, width, fan, 0)
            slot, distance = np.empty(len(cell), dtype=np.int64), np.empty(len(cell))
            order = np.argsort(cell, kind="stable")
            found: list[tuple] = []
            for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                at = int(cell[own[0]])
                slots, values, gone = listed(batch.column("_near")[int(own[0])].values) if given is None else given[at]
                if gone is not None and cells.missing is None:
                    cells.missing = np.zeros(cells.x.shape, dtype=bool)
                if gone is None and cells.missing is not None:
                    gone = np.zeros(values.shape, dtype=bool)
                slot[own], distance[own] = cells.assign(own, slots, values, gone)
                if summed:
                    found.append((at, *cells.totals(own, slot[own])))
            if summed:
                cell_of = np.concatenate([np.empty(0, dtype=np.int64), *(np.full(len(x[1]), x[0]) for x in found)])
                slot_of = np.concatenate([np.empty(0, dtype=np.int64), *(x[1] for x in found)])
                bounds = pa.array(np.arange(len(cell_of) + 1, dtype=np.int32) * width, pa.int32())
                sums, known = (np.concatenate([np.empty((0, width)), *(x[i] for x in found)]).ravel() for i in (2, 3))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (sums, known)]
                columns = [pa.array(cell_of), pa.array(slot_of, pa.int32(), mask=slot_of < 0), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "slot", "sums", "known"])
            else:
                columns = [*(batch.column(c) for c in kept), *_told(slot, slot, distance, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "slot", "distance"])

    if summed:
        return rows.mapInArrow(nearest, "cell bigint, slot int, sums array<double>, known array<double>")
    return rows.mapInArrow(nearest, StructType([*fields, StructField("slot", IntegerType()), StructField("distance", DoubleType())]))


def _told(number: np.ndarray, slot: np.ndarray, distance: np.ndarray, kind: pa.DataType) -> list[pa.Array]:
    """Numbers and distances; null without a slot (but for a distance to a centre that is missing, which is infinite)."""
    lost = slot < 0
    return [pa.array(number, kind, mask=lost), pa.array(distance, pa.float64(), mask=lost & np.isnan(distance))]


def _of(table: pa.Table, width: int, fan: int, seed: int) -> tuple[Cells, tuple[int, int, int]]:
    cell, quota, level = (table.column(c)[0].as_py() for c in ("cell", "_quota", "_level"))
    return Cells(table.column("features"), table.column("_hash"), width, fan, seed), (cell, quota, level)


def depth_below(rows: DataFrame, width: int, dividing: int, fan: int, seed: int) -> DataFrame:
    """``depth`` of the deepest cell below each cell of ``rows`` (``features`` and GIVEN)."""

    def deepest(table: pa.Table) -> pa.Table:
        cells, top = _of(table, width, fan, seed)
        return pa.table({"depth": pa.array([max((level for _, _, level, _ in cells.leaves(*top, dividing)), default=0)], pa.int32())})

    return rows.groupBy("cell").applyInArrow(deepest, "depth int")


def finished(
    rows: DataFrame, width: int, dividing: int, rounds: int, fan: int, seed: int, depth: int, nearest: bool
) -> DataFrame:
    """The rows with ``cluster`` and ``distance``, and the centres as further rows (``_mean``) with ``cluster`` and ``center``.

    ``nearest`` leaves out rows of a cluster that has nearer ones.
    """
    kept = [c for c in rows.columns if c not in GIVEN]
    fields = [StructField(f.name, f.dataType, True) for f in rows.schema if f.name in kept]
    added = [StructField("cluster", LongType()), StructField("distance", DoubleType())]
    added += [StructField("center", ArrayType(DoubleType())), StructField("_mean", BooleanType())]

    def finish(table: pa.Table) -> pa.Table:
        cells, top = _of(table, width, fan, seed)
        taken, clusters, distances, means, values, unknown = [], [], [], [], [], []
        for cell, quota, _, own in cells.leaves(*top, dividing):
            slot, distance, slots, centers, gone = cells.lloyd(own, quota, rounds, seed + depth)
            means.append(np.where(slots < 0, -1, cell * fan + slots + 1))
            values.append(centers)
            unknown.append(np.zeros(centers.shape, dtype=bool) if gone is None else gone)
            if nearest:
                far = np.where(np.isnan(distance), np.inf, distance)
                least = np.full(fan + 1, np.inf)
                np.minimum.at(least, slot + 1, far)
                near = (far <= least[slot + 1]) | (slot < 0)
                own, slot, distance = own[near], slot[near], distance[near]
            taken.append(own)
            clusters.append(np.where(slot < 0, -1, cell * fan + slot + 1))
            distances.append(distance)
        none = np.empty(0, dtype=np.int64)
        own, cluster, distance = (np.concatenate([none, *x]) for x in (taken, clusters, distances))
        mean, value = np.concatenate([none, *means]).astype(np.int64), np.concatenate([np.empty((0, width)), *values])
        lost = np.concatenate([np.empty((0, width), dtype=bool), *unknown])
        data = table.select(kept).take(pa.array(own.astype(np.int64)))
        blank = pa.nulls(len(own), pa.list_(pa.float64()))
        bounds = pa.array(np.arange(len(mean) + 1, dtype=np.int32) * width, pa.int32())
        listed = pa.ListArray.from_arrays(bounds, pa.array(value.ravel(), pa.float64(), mask=lost.ravel()))
        first = [*data.columns, *_told(cluster.astype(np.int64), cluster, distance, pa.int64()), blank, pa.array(np.zeros(len(own), dtype=bool))]
        second = [*(pa.nulls(len(mean), c.type) for c in data.columns), pa.array(mean, mask=mean < 0), pa.nulls(len(mean), pa.float64()), listed, pa.array(np.ones(len(mean), dtype=bool))]
        names = [*kept, "cluster", "distance", "center", "_mean"]
        return pa.concat_tables([pa.table(dict(zip(names, first))), pa.table(dict(zip(names, second)))], promote_options="permissive")

    return rows.groupBy("cell").applyInArrow(finish, StructType([*fields, *added]))

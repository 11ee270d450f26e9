"""Placing rows on shards with a weighted hash tree (regions, racks, shards).

A row descends the tree. At each node every child draws a number from a hash of the
row's key and the child's name, divided by the child's weight; the smallest draw
wins, so a child receives a share of the rows in proportion to its weight. Draws of a
child depend on that child alone: if weights change, rows move only into or out of subtrees
whose weight changed, and a new subtree takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreloom.llm.names import unused
from coreloom.llm.numbering import number
from coreloom.llm.registry import query, table


@dataclass(frozen=True)
class Node:
    """A subtree: a leaf has a shard number and a weight, an inner node's weight is its leaves' sum."""

    name: str
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def tree(regions: int, racks: int, shards: int, extra: int = 0) -> Node:
    """An even tree of regions x racks x shards; each of ``extra`` shards is a region of its own."""
    numbers = iter(range(regions * racks * shards + extra))
    even = [
        Node(f"region{r}", tuple(
            Node(f"region{r}/rack{k}", tuple(
                Node(f"region{r}/rack{k}/shard{n}", shard=n) for n in (next(numbers) for _ in range(shards))
            )) for k in range(racks)
        )) for r in range(regions)
    ]
    more = [
        Node(f"region{regions + e}", (Node(f"region{regions + e}/rack0", (
            Node(f"region{regions + e}/rack0/shard{n}", shard=n),)),))
        for e, n in enumerate(numbers)
    ]
    return Node("", tuple(even + more))


def _draw(key: Column, child: Node) -> Column:
    """Exponential with the child's weight as rate; 52 hash bits, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 12)
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(child.weight))


def _winner(key: Column, children: tuple[Node, ...]) -> Column:
    drawing = [c for c in children if c.weight > 0]
    if not drawing:
        raise ValueError("every child has weight 0")
    if len(drawing) == 1:
        return F.lit(drawing[0].name)
    return F.array_min(F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(c.name).alias("name")) for c in drawing]))["name"]


def place(df: DataFrame, key: str, root: Node, name: str = "shard") -> DataFrame:
    """Attach ``name`` (int), the shard of each row; no shuffle, other columns stay.

    The key alone decides: equal keys, null included, share a shard. A column called ``name`` is replaced.
    """
    inner = [c for c in df.columns if c != name]
    at, level = unused([*inner, name, key], "_node_at"), [root]
    df = df.select(*inner).withColumn(at, F.lit(root.name))
    while any(node.children for node in level):
        choice = F.col(at)
        for node in level:
            if node.children:
                choice = F.when(F.col(at) == node.name, _winner(F.col(key), node.children)).otherwise(choice)
        df = df.withColumn(at, choice)
        level = [c for node in level for c in (node.children or (node,))]
    shards = F.create_map(*[F.lit(x) for leaf in level for x in (leaf.name, leaf.shard)])
    return df.withColumn(name, F.element_at(shards, F.col(at)).cast("int")).drop(at)


def sharded(docs: DataFrame, root: Node, grown: Node) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Size is the text's UTF-8 bytes (null: none) plus 8. Slots are gapless from 0 within a
    shard; they follow a hash order, so a shard of any size is numbered in portions.
    Repeated rows get a slot each; null ids share a shard.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = place(place(rows, "doc_id", root, "shard"), "doc_id", grown, "grown_shard")
    return number(placed, ["shard"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, root: Node, path: str, key: str = "doc_id") -> None:
    """Write whole rows below ``path``, one folder per shard; no shuffle, so every task adds to every shard."""
    place(docs, key, root, "shard").write.partitionBy("shard").parquet(path)


@query("op3_weighted_hash_tree")
def op3(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents"), tree(2, 3, 4), tree(2, 3, 4, extra=1))

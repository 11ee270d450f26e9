"""The hash tree: contract columns, balance, weights and movement."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from coreloom.llm import numbering, sharding
from coreloom.llm.sharding import Node, place, sharded, tree


def check(rows, docs):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    shard_of = {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key"
        assert shard_of.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
    for numbers in slots.values():
        assert sorted(numbers) == list(range(len(numbers)))


def test_contract(spark, sf, odd_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        check(sharded(docs, tree(2, 3, 4), tree(2, 3, 4, 1)).collect(), docs.collect())
    assert sharded(odd_docs.limit(0), tree(2, 3, 4), tree(2, 3, 4, 1)).count() == 0


def test_draws_recomputed(spark):
    """Every row's shard, walked down the tree with plain weighted hash draws."""

    def walk(key, node):
        while node.children:
            drawn = []
            for child in node.children:
                if child.weight > 0:
                    first = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
                    bits = xxhash.xxh64(child.name.encode(), seed=first).intdigest() >> 12
                    drawn.append((-math.log((bits + 0.5) / 2**52) / child.weight, child.name, child))
            node = min(drawn)[2]
        return node.shard

    heavy = Node("", (Node("A", (Node("a", shard=0, leaf_weight=3.0), Node("b", shard=1, leaf_weight=0.0))), Node("C", shard=2, leaf_weight=1.5)))
    keys = spark.range(-2000, 2000).withColumnRenamed("id", "_node_at")
    for root in (tree(2, 3, 4), tree(2, 3, 4, 1), heavy):
        rows = place(keys, "_node_at", root).collect()
        assert all(r["shard"] == walk(r["_node_at"], root) for r in rows)


def test_balance_and_growth(spark):
    keys = spark.range(60_000).withColumnRenamed("id", "k")
    rows = place(place(keys, "k", tree(2, 3, 4), "a"), "k", tree(2, 3, 4, 1), "b").collect()
    sizes = Counter(r["a"] for r in rows)
    assert len(sizes) == 24 and all(abs(n - 2500) < 300 for n in sizes.values())
    moved = [r for r in rows if r["a"] != r["b"]]
    assert abs(len(moved) - 2400) < 300 and all(r["b"] == 24 for r in moved)


def test_changed_weight_moves_only_that_subtree(spark):
    def two(weight):
        leaf = lambda n, w=1.0: Node(f"s{n}", shard=n, leaf_weight=w)
        return Node("", (Node("A", (leaf(0), leaf(1))), Node("B", (leaf(2), leaf(3, weight))), Node("C", (leaf(4), leaf(5, 0.0)))))

    keys = spark.range(20_000).withColumnRenamed("id", "k")
    rows = place(place(keys, "k", two(1.0), "a"), "k", two(3.0), "b").collect()
    assert Counter(r["b"] for r in rows)[5] == 0
    assert abs(Counter(r["b"] for r in rows)[3] - 20_000 * 3 / 7) < 500
    for r in rows:
        if r["a"] != r["b"]:
            assert r["b"] in (2, 3)
            assert r["a"] not in (2, 3) or (r["a"], r["b"]) == (2, 3)


def test_repeated_rows_get_own_numbers(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RUN", 7)
    monkeypatch.setattr(numbering, "SORTED_TOGETHER", 10)
    rows = spark.range(300).select((F.col("id") % 2).cast("int").alias("g"), F.when(F.col("id") < 200, 1).alias("x"))
    got = defaultdict(list)
    for r in numbering.number(rows, ["g"], "n").collect():
        got[r["g"]].append(r["n"])
    assert {g: sorted(n) for g, n in got.items()} == {0: list(range(150)), 1: list(range(150))}


def test_written_shards(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, tree(1, 1, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd_docs.count() and {r["shard"] for r in back.collect()} <= {0, 1, 2}

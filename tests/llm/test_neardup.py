"""SimHash links and classes against a brute-force version."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from coreloom.llm import neardup
from coreloom.llm.graph import components


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids_and_prints):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted({p for _, p in ids_and_prints})
    for p in distinct:
        parent[p] = p
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(b)] = find(a)
    lowest = {}
    for d, p in ids_and_prints:
        r = find(p)
        if d is not None:
            lowest[r] = min(d, lowest.get(r, d))
    return {(d, p): lowest.get(find(p)) for d, p in ids_and_prints}


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    reached = brute_components(want)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted(
        (d, f"{p:016x}", reached[(d, p)]) for d, p in want
    )


def test_odd_rows(spark, odd_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    want = [(r["doc_id"], brute_print(r["text"])) for r in odd_docs.collect()]
    reached = brute_components(want)
    assert sorted(map(str, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got))) == sorted(
        str((d, f"{p:016x}", reached[(d, p)])) for d, p in want
    )


def test_empty_table(spark, odd_docs):
    assert neardup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_crowded_keys_lose_no_connection(spark, monkeypatch):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) << rng.randrange(64) for _ in range(300)}
    chain = rng.getrandbits(64)
    for k in range(0, 40, 2):
        chain ^= 3 << k
        prints.add(chain)
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "doc_id bigint, fingerprint bigint")
    want = {d: c for (d, _), c in brute_components(rows).items()}
    for most in (1, 24, 10_000):
        monkeypatch.setattr(neardup, "PAIRWISE", most)
        got = {r["doc_id"]: r["component_id"] for r in neardup.classes(df).collect()}
        assert got == want


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 9), (9, 9), (20, 21), (21, 22), (22, 23), (23, 20), (7, None)], "u bigint, v bigint")
    got = {r["vertex"]: r["component"] for r in components(edges).collect()}
    assert got == {4: 4, 5: 4, 9: 4, 20: 20, 21: 20, 22: 20, 23: 20}
    assert components(edges.limit(0)).count() == 0
    chain = spark.range(500).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components(chain).select("component").distinct().count() == 1


def first_of_each(rows):
    """Per component of the brute-force links the smallest id, as (id, text); null last."""
    prints = [(d, brute_print(t)) for d, t in rows]
    best = {}
    links = {}
    for _, p in prints:
        links[p] = p

    def find(x):
        while links[x] != x:
            x = links[x]
        return x

    distinct = sorted(links)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                links[find(b)] = find(a)
    for (d, p) in prints:
        key = (d is None, d or 0)
        best[find(p)] = min(key, best.get(find(p), key))
    return sorted(str(None if last else d) for last, d in best.values())


def test_one_of_each(spark, odd_docs, sf):
    kept = neardup.one_of_each(odd_docs)
    assert kept.schema == odd_docs.schema
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    assert got == first_of_each(rows)
    assert sorted(str(r["doc_id"]) for r in neardup.one_of_each(odd_docs.unionAll(odd_docs)).collect()) == got
    assert neardup.one_of_each(odd_docs.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = first_of_each([(r["doc_id"], r["text"]) for r in docs.collect()])
    stays = neardup.one_of_each(docs)
    assert sorted(str(r["doc_id"]) for r in stays.collect()) == want
    assert stays.exceptAll(docs).count() == 0


def test_copies_go_without_a_broadcast(spark, monkeypatch):
    from coreloom.operators import bounded

    monkeypatch.setattr(bounded, "MAX_PINNED_ROWS", 0)
    monkeypatch.setattr(bounded, "HOT_PART", 5)
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(900)]
    texts = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)]
    texts += [(100 + i, texts[3][1]) for i in range(60)] + [(3, texts[3][1]), (7, texts[8][1]), (None, texts[9][1])]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("_mark", F.lit("own")).withColumn("_own", F.lit(1))
    kept = neardup.one_of_each(df)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == first_of_each(texts)
    assert {r["_mark"] for r in kept.collect()} == {"own"}
    got = neardup.near_duplicates(df).collect()
    reached = brute_components([(d, brute_print(t)) for d, t in texts])
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(str((d, reached[(d, brute_print(t))])) for d, t in texts)

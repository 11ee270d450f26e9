"""Edited texts, fingerprints and radius search against brute force."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from coreloom.llm import fingerprints


def brute_print(text):
    votes, total = [0] * 64, 0
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        weight = 1 if len(word) <= 3 else 2 if len(word) <= 6 else 3
        h = xxhash.xxh64(word.encode(), seed=42).intdigest()
        total += weight
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def expected(rows):
    """rows: (doc_id, text) in the order of the comparison."""
    out = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), brute_print(text), brute_print(changed), brute_print(following)))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    want = [(d, n, s, *map(signed, p)) for d, n, s, *p in expected(rows)]
    for portion in (2_000, 7, 1):
        monkeypatch.setattr(fingerprints, "PORTION_ROWS", portion)
        got = [tuple(r) for r in fingerprints.compared(docs).collect()]
        assert sorted(got) == sorted(want)


def test_one_hot_id_is_spread(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PORTION_ROWS", 10)
    rows = [(5 if i % 3 else i, f"text number {i} " * 4) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = fingerprints.with_next(docs).cache()
    assert placed.where("doc_id = 5").select("_portion").distinct().count() > 5
    assert placed.count() == 240 and placed.where("next_text IS NULL").count() == 0
    # Following the successors visits every row once.
    after = {(r["_portion"], r["_at"]): ((r["_next_portion"], r["_next_at"]), r["next_text"], r["text"]) for r in placed.collect()}
    at, seen = next(iter(after)), 0
    while True:
        (at, following, _), seen = after[at], seen + 1
        assert after[at][2] == following
        if seen == 240:
            break
    assert at == next(iter(after))


def test_odd_rows(spark, odd_docs):
    rows = fingerprints.compared(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    ids = sorted((r["doc_id"] for r in rows if r["doc_id"] is not None), reverse=True)
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id IS NOT NULL").collect()}
    assert len(ids) == 10
    nine = next(r for r in rows if r["doc_id"] == 9)
    third = len(texts[9]) // 3
    assert nine["edited_sha256"] == hashlib.sha256((texts[9][: len(texts[9]) - third] + texts[8][:third]).encode()).hexdigest()
    assert fingerprints.compared(odd_docs.limit(0)).count() == 0
    one = fingerprints.compared(odd_docs.where("doc_id = 1")).first()
    assert one["own"] == one["following"]


def test_radius_search(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(200)]
    for p in prints[:60]:
        for k in range(1, 6):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints))
    corpus = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint bigint")
    queries = spark.createDataFrame([(signed(p),) for p in prints[::3]], "fingerprint bigint")
    for radius in (1, 2, 3):
        want = {(signed(a), signed(b)) for a in prints[::3] for b in prints if bin(a ^ b).count("1") <= radius}
        got = [(r["query"], r["match"]) for r in fingerprints.neighbours(queries, corpus, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_counts(spark):
    rows = [(0, 0), (1, 0), (50, 7), (51, 15), (100, -1), (7, 1 << 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint")
    got = {r["fingerprint"]: r["near_docs"] for r in fingerprints.near_counts(df).collect()}
    assert got == {0: 3, 7: 3, -1: 0}
    assert fingerprints.near_counts(df.where(F.lit(False))).count() == 0

"""Exact duplicates against a plain grouping of the texts."""

import hashlib
import random

import pytest

from coreloom.llm import exact


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for text, docs in groups.items():
        known = [d for d in docs if d is not None]
        best = max(known) if known else None
        left = 1
        digest = hashlib.sha256(text.encode()).hexdigest()
        for doc in docs:
            kept = doc == best and left > 0
            left -= kept
            out.append((doc, best, len(docs), kept, digest))
    return sorted(out, key=str)


def check(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(map(tuple, exact.duplicate_groups(docs, **more).collect()), key=str)


def planted():
    rng = random.Random(3)
    bases = ["", "a", "same start " * 40, "x" * 5000, "é" * 700, "long \x00 text " * 3000]
    texts = bases + [b + "!" for b in bases] + ["?" + b for b in bases] + [b[:-1] + "#" for b in bases if b]
    rows = [(n, rng.choice(texts)) for n in range(150)]
    rows += [(1_000 + n, "hot " * 30) for n in range(150)]
    rows += [(None, "a"), (None, "only null"), (None, "only null"), (7, "twice"), (7, "twice"), (8, None), (-3, None)]
    return rows


@pytest.mark.parametrize("first_bytes", [1, 64])
def test_equal_texts(spark, first_bytes):
    rows = planted()
    assert check(spark, rows, first_bytes=first_bytes) == brute(rows)


def test_hot_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact, "HOT_PART", 4)
    rows = planted()
    assert check(spark, rows, first_bytes=2) == brute(rows)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, exact.duplicate_groups(odd_docs).collect()), key=str) == brute(rows)


def test_empty_table(spark, odd_docs):
    found = exact.duplicate_groups(odd_docs.limit(0))
    assert found.collect() == []
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]

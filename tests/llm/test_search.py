"""Ranked search against a plain scoring of every document for every item."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from coreloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(small)


def brute(docs, items, k=10):
    texts = [(d, plain_terms(t)) for d, t in docs]
    texts = [(d, t) for d, t in texts if t]
    total, words = len(texts), sum(len(t) for _, t in texts)
    out = []
    for item, text in items:
        asked = plain_terms(text)
        weights = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in own for _, own in texts) + 1))) for t in set(asked)}
        scored = []
        for doc, own in texts:
            m = 100 - 75 + (75 * len(own) * total) // words
            score = 0
            for t in asked:
                tf = own.count(t)
                score += weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((doc, score))
        scored.sort(key=lambda s: (-s[1], s[0] is None, s[0] or 0))
        out += [(item, r + 1, d, s) for r, (d, s) in enumerate(scored[:k])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    words = [f"w{n}" for n in range(60)]
    pick = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=n))
    docs = [(n, pick(rng.randint(1, 40))) for n in range(400)] + [(1000 + n, "w50 w51, W52! w50") for n in range(30)]
    items = [(n, pick(rng.randint(1, 12))) for n in range(25)] + [(99, "w50 w51"), (99, "w50 w51"), (100, "absent")]
    return docs, items


@pytest.mark.parametrize("cells", [4_000_000, 700])
def test_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(search, "CELLS", cells)
    docs, items = corpus()
    found = search.ranked(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_large_scores_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(search, "WHOLE", 1.0)
    docs, items = corpus()
    found = search.ranked(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_odd_rows(spark, odd_docs):
    items = [(1, "ALPHA beta"), (2, None), (3, "..."), (4, "lorem É 😀 x"), (None, "alpha"), (5, "x" * 50000)]
    asked = spark.createDataFrame([(*i, 1, "t") for i in items], "item_id bigint, text string, rank int, terms string")
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, search.ranked(odd_docs, asked).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, odd_docs):
    items = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    assert search.ranked(odd_docs.limit(0), items).collect() == []
    assert search.ranked(odd_docs, items.limit(0)).collect() == []


@given(st.text())
def test_terms(text):
    assert [t.decode() for t in search.terms_of(text.encode())] == plain_terms(text)


def test_pruning_drops_whole_nodes(monkeypatch):
    """Alike documents side by side: most documents are never scored by themselves."""
    rng = np.random.default_rng(4)
    parts = np.zeros((512, 32))
    for d in range(512):
        parts[d, d // 16] = rng.integers(500, 1000)
    weights = np.eye(32)[:8] * 7
    items = search.ItemTree(weights, np.ones(8, dtype=np.int64))
    scored = []
    offer = items.offer
    monkeypatch.setattr(items, "offer", lambda i, s, d: (scored.append(len(s)), offer(i, s, d)))
    search.descend(items, parts, np.arange(512))
    assert sum(scored) == 8 * 16
    for at, item in enumerate(items.order):
        exact = sorted(((-int(7 * parts[d, item]), d) for d in range(512)))[:10]
        assert [(-s, d) for s, d in exact] == list(zip(items.scores[at], items.ids[at]))

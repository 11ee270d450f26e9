"""Held-out accuracy, leakage and odd rows."""

import zlib

import pytest

from coreloom.llm import toxicity


def test_learns_what_the_labels_mark(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.fit(docs, labels).score(docs).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    found = [r for r in held if r["predicted"]]
    toxic = [r for r in held if r["toxic"]]
    hits = sum(r["toxic"] for r in found)
    assert hits >= 0.9 * len(found) and hits >= 0.85 * len(toxic)
    brier = sum((r["score"] - r["toxic"]) ** 2 for r in held) / len(held)
    assert brier < 0.03


def test_held_out_labels_do_not_matter(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a = {r["doc_id"]: r["score"] for r in toxicity.fit(docs, labels).score(docs).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.fit(docs, flipped).score(docs).collect()}
    assert a == b and all(0 <= s <= 1 for s in a.values())


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, 1, None)], "doc_id bigint, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        out = toxicity.filter_clean(odd_docs, given)
        assert out.columns == odd_docs.columns
    assert toxicity.filter_clean(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert toxicity.fit(odd_docs.limit(0), labels).score(odd_docs).count() == odd_docs.count()
    rows = toxicity.features(odd_docs, ["idiot"]).collect()
    assert len(rows) == odd_docs.count() and all(len(r["_features"]) == len(toxicity.FEATURES) for r in rows)


@pytest.mark.parametrize(("word", "want"), [("1d10t!", "idiot"), ("Stuuuupid,", "stupid"), ("st*upid", "stupid"), ("2024", "2024"), ("...", "")])
def test_plain(word, want):
    assert toxicity.plain(word) == want


def test_second_person_near():
    import numpy as np

    mark = toxicity._marker(frozenset(["idiot"]), frozenset(), frozenset(["you"]))
    far = np.array([mark(w) for w in ("you " + "x " * 30 + "idiot").split()])
    near = np.array([mark(w) for w in ("x " * 30 + "you idiot").split()])
    at = toxicity.FEATURES.index("near_second")
    assert toxicity.row_features(far)[at] == 0 and toxicity.row_features(near)[at] > 0


def test_long_words_count_whole(spark):
    texts = ["A" * 10_000, "a" * 70_000 + " " + "!" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: dict(zip(toxicity.FEATURES, r["_features"])) for r in toxicity.features(docs, []).collect()}
    assert rows[0]["capitals"] == 1.0 and rows[0]["punctuation"] == 0
    assert rows[1]["capitals"] == 0 and rows[1]["punctuation"] == 0.5 and rows[1]["exclaims"] == 35_000

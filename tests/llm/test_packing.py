"""Pieces, patterns and places."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from coreloom.llm import packing, vocab

FILE = vocab.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def test_chunks_give_the_texts_ids(tokenizer):
    rng = random.Random(8)
    own = packing.ChunkTokenizer(FILE)
    signs = list(" \n\t .,'ÉéßΣσς1") + ["don't", "\r\n", "it's", "ΟΔΟΣ", "<|endoftext|>", "á", "́", " ", " ", "😀", "word", "\x85", "\x1c"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode_bytes(text), "<u4").tolist() == want, repr(text)


def test_words_that_go_straight_to_the_merges(tokenizer):
    rng = random.Random(12)
    own = packing.ChunkTokenizer(FILE)
    assert own.direct
    signs = packing.LETTERS * 3 + "AÉΣς1,.'\x01́"
    words = ["".join(rng.choices(signs if n % 4 else packing.LETTERS, k=rng.randint(1, 14))) for n in range(6000)]
    got = own.encode_many(words)
    for word, ids in zip(words, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, repr(word)
    own.direct = None
    own.words.clear()
    assert own.encode_many(words) == got


def test_columns_of_texts(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "WORDS_TOGETHER", 3)
    own = packing.ChunkTokenizer(FILE)
    own.words.most = 5  # nearly everything is forgotten at once
    texts = ["The THE the, cat.", None, "", "  a\n\nb  ", "x" * 300, "É é <|endoftext|>. \x01 it's", "The cat"] * 3
    ids, ends = own.encode_column(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(packing.portions(pa.array(["aa", None, "b" * 9, "", "c"]), 4)) == [(0, 2), (2, 3), (3, 5)]
    assert own.encode_column(pa.array([], pa.string()))[1].tolist() == [0]


def test_case_must_not_matter():
    with pytest.raises(ValueError, match="does not drop"):
        packing.ChunkTokenizer(vocab.path("byte_bpe_50k.json"))


def check(rows, docs, tokenizer):
    ids = defaultdict(list)
    for r in docs:
        ids[r["doc_id"]].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        want = []
        for whole in ids[doc]:
            for at in range(0, len(whole), 4096):
                part = np.array(whole[at : at + 4096], "<u4")
                want.append((at, len(part), zlib.crc32(part.tobytes()), len(whole)))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own) == sorted(want)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return len(by_sequence)


def test_documents(spark, sf, odd_docs, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.packed(docs, FILE).collect()
    sequences = check(rows, docs.collect(), tokenizer)
    tokens = sum(r["length"] for r in rows)
    assert sequences <= 1.03 * tokens / 4096 + 1
    check(packing.packed(odd_docs, FILE).collect(), odd_docs.collect(), tokenizer)
    assert packing.packed(odd_docs.limit(0), FILE).count() == 0


def test_ids_column(spark, odd_docs, tokenizer):
    for r in packing.cut(odd_docs.where("doc_id = 9"), FILE).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["ids"][-1] == 2


def test_knapsack_against_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        prices = np.array([rng.uniform(-0.2, 1) for _ in range(7)])
        value, pattern = packing.knapsack(prices, 7)

        def best(room, prices=prices):
            return max([0.0] + [prices[s - 1] + best(room - s) for s in range(1, room + 1)])

        assert abs(value - best(7)) < 1e-9 and abs(pattern @ prices - value) < 1e-9
        assert pattern @ np.arange(1, 8) <= 7


def test_plan_uses_up_every_demand():
    rng = random.Random(9)
    for _ in range(20):
        demand = [rng.choice([0, 0, rng.randint(1, 9), rng.randint(1, 5000)]) for _ in range(32)]
        chosen = packing.plan(demand)
        got = [0] * 32
        for pattern, times in chosen:
            assert times > 0 and sum(c * k for c, k in pattern.items()) <= 32
            for c, k in pattern.items():
                got[c - 1] += k * times
        assert got == demand
        relaxed = sum(amount for _, amount in packing.column_generation(np.array(demand)))
        assert sum(c * d for c, d in enumerate(demand, 1)) / 32 <= relaxed + 1e-6
        assert sum(t for _, t in chosen) <= relaxed + 33
    assert packing.plan([0] * 8) == []


def test_clashing_names(spark):
    rows = [(n % 50 + 1, f"k{n}", n, "s", 1.0) for n in range(300)] + [(7, "twin", 1, "s", 1.0)] * 3
    pieces = spark.createDataFrame(rows, "length bigint, _class string, _slot int, _n string, c0 double")
    got = packing.pack(pieces, 64, 1)
    assert got.columns == ["length", "_class", "_slot", "_n", "c0", "sequence_id", "offset"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(rows)


def test_wrong_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(5000,)], "length bigint"))


def test_relaxation_is_a_lower_bound_and_near_the_optimum():
    rng = random.Random(4)

    def optimum(items, capacity):
        best = len(items)

        def go(k, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(items):
                best = len(rooms)
                return
            for i in range(len(rooms)):
                if rooms[i] >= items[k] and rooms[i] not in rooms[:i]:
                    go(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
            go(k + 1, rooms + [capacity - items[k]])

        go(0, [])
        return best

    for _ in range(25):
        demand = [rng.randint(0, 2) for _ in range(8)]
        items = sorted((c for c, d in enumerate(demand, 1) for _ in range(d)), reverse=True)
        relaxed = sum(amount for _, amount in packing.column_generation(np.array(demand)))
        exact = optimum(items, 8)
        assert exact - 1 < relaxed + 1e-6 <= exact + 2e-6
        assert exact <= sum(t for _, t in packing.plan(demand)) <= exact + 1

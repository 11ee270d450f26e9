"""The piece codec against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece

from coreloom.llm import pieces, vocab


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocab.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return pieces.codec(vocab.path("piece_bpe_32k.model"))


def test_random_texts(own, library):
    rng = random.Random(5)
    signs = list(" \n\t.,'\"()ab cdéß梦\U0001f600▁\x00the ing<s>12，。_") + ["https://", "don't", "e.g.", "    ", "é", "\r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids)


def test_any_ids_decode(own, library):
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(0, 259) for _ in range(10)]
        assert own.decode(ids) == library.decode(ids), ids


def test_long_chunk_and_spaces(own, library):
    for text in ("x" * 20000, " " * 777, "ab" * 5000 + "é" * 3000, "\n" * 100, None, ""):
        assert own.encode(text) == library.encode(text or "", add_bos=True, add_eos=True)


def test_stepping_back_is_needed_and_right(own, library):
    """Some text's greedy walk is not the merge result."""
    texts = ["".join(p) for p in zip("thintheringsonandersation" * 40, "ingthereonsandatxqzwhe" * 45)]
    words = ["".join(random.Random(i).choices(["th", "in", "er", "an", "on", "re", "ti", "es"], k=9)) for i in range(400)]
    stepped = 0
    for text in texts + words:
        greedy = [p for _, p in own.automaton.iter_long("▁" + text)]
        stepped += own._pieces("▁" + text) != greedy
        assert own.encode(text) == library.encode(text, add_bos=True, add_eos=True)
    assert stepped


def test_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHED_CHUNKS", 3)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 2)
    small = pieces.PieceCodec(vocab.path("piece_bpe_32k.model"))
    text = "one two three four five six one two seven"
    assert small.encode(text) == library.encode(text, add_bos=True, add_eos=True)
    assert len(small.chunks) <= 3


def test_digests(spark, sf, odd_docs, library):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        want = []
        for r in docs.collect():
            ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            want.append((r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        got = [tuple(r) for r in pieces.digests(docs, vocab.path("piece_bpe_32k.model")).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_encode_keeps_columns(spark, odd_docs, library):
    out = pieces.encode(odd_docs, vocab.path("piece_bpe_32k.model"))
    assert out.columns == [c for c in odd_docs.columns if c != "ids"] + ["ids"]
    for r in out.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_bos=True, add_eos=True)
    assert pieces.encode(odd_docs.limit(0), vocab.path("piece_bpe_32k.model")).count() == 0

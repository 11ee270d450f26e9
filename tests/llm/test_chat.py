"""Perspective rotation on a small dialogue and odd rows."""

from coreloom.llm import chat


def rendering(rows, conv, who):
    own = sorted((r for r in rows if r["conv_id"] == conv and r["perspective"] == who), key=lambda r: r["start"])
    text = "".join(r["segment"] for r in own)
    for r in own:
        assert text[r["start"] : r["end"]] == r["segment"]
    learnt = [text[r["mask_start"] : r["mask_end"]] for r in own if r["mask_start"] is not None]
    return text, learnt


def test_three_speakers(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé 😀"), (1, 3, "cy", "Yo"), (1, 4, "ann", "Bye")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = chat.rotate(turns).collect()
    assert len(rows) == 15
    text, learnt = rendering(rows, 1, "ann")
    assert text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
        "<|im_start|>user name=bob\nHé 😀<|im_end|>\n<|im_start|>user name=cy\nYo<|im_end|>\n"
        "<|im_start|>assistant\nBye<|im_end|>\n"
    )
    assert learnt == ["Hi<|im_end|>", "Bye<|im_end|>"]
    assert rendering(rows, 1, "bob")[1] == ["Hé 😀<|im_end|>"]


def test_odd_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "PORTION", 2)
    turns = spark.createDataFrame(
        [(1, k, f"p{k % 2}", "t" * k) for k in range(11)]
        + [(None, 0, "a", "x"), (None, None, None, None), (2, 0, "system", "alone"), (3, 5, "a", "same"), (3, 5, "a", "same"), (3, 5, "b", "")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = chat.rotate(turns).collect()
    assert not [r for r in rows if r["conv_id"] == 2]
    assert len([r for r in rows if r["conv_id"] == 3]) == 6
    for conv, who in ((1, "p0"), (1, "p1"), (None, "a"), (None, "unnamed"), (3, "a"), (3, "b")):
        text, _ = rendering(rows, conv, who)
        assert len(text) == max(r["end"] for r in rows if r["conv_id"] == conv and r["perspective"] == who)
    assert chat.rotate(turns.limit(0)).count() == 0

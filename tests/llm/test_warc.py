"""Archives: round trip, revisits, and salvage of damaged files."""

import base64
import gzip
import hashlib
import random
import shutil

import pytest

from coreloom.llm import warc


def record(n, payload, kind="response", digest=True):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{n}>\r\n"
    if digest:
        head += "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() + "\r\n"
    return (head + f"Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def found(data):
    out = list(warc.salvage(data))
    return [f[3]["warc-record-id"][12:-1] for f in out if f[0] == "record"], [(f[1], f[2]) for f in out if f[0] == "gap"]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage(pack):
    payloads = [b"alpha" * 40, b"", b"inner\nWARC/1.1\r\nfalse start\r\n\r\n", b"\x1f\x8b\x08 not a member", b"omega" * 10]
    parts = [pack(record(n, p)) for n, p in enumerate(payloads)]
    whole = b"".join(parts)
    ends = [sum(map(len, parts[: k + 1])) for k in range(5)]
    assert found(whole) == (["0", "1", "2", "3", "4"], [])
    spoilt = bytearray(whole)
    spoilt[ends[1] + len(parts[2]) // 2] ^= 0xFF
    ids, gaps = found(bytes(spoilt))
    assert ids == ["0", "1", "3", "4"] and gaps == [(ends[1], ends[2])]
    junk = b"\x00junk WARC/1.1 \x1f\x8b\x08more"
    ids, gaps = found(whole[: ends[0]] + junk + whole[ends[0] :])
    assert ids == ["0", "1", "2", "3", "4"] and gaps == [(ends[0], ends[0] + len(junk))]
    ids, gaps = found(whole[:-6])
    assert ids == ["0", "1", "2", "3"] and gaps == [(ends[3], len(whole) - 6)]
    ids, gaps = found(whole[5:])
    assert ids == ["1", "2", "3", "4"] and gaps == [(0, ends[0] - 5)]
    assert found(b"") == ([], []) and found(b"nothing here") == ([], [(0, 12)])


def test_salvage_finds_records_that_no_line_feed_precedes():
    parts = [record(n, b"payload %d" % n) for n in range(4)]
    ends = [sum(map(len, parts[: k + 1])) for k in range(4)]
    glued = parts[0] + parts[1][:-4] + parts[2] + parts[3]  # the second record lost its closing blank lines
    assert found(glued) == (["0", "2", "3"], [(ends[0], ends[1] - 4)])
    cut = parts[0] + parts[1][: len(parts[1]) // 2] + parts[2] + parts[3]
    assert found(cut) == (["0", "2", "3"], [(ends[0], ends[0] + len(parts[1]) // 2)])
    wrong = parts[1].replace(b"Content-Length: ", b"Content-Length: 9")
    assert found(parts[0] + wrong + parts[2]) == (["0", "2"], [(ends[0], ends[0] + len(wrong))])
    false = b"WARC/1.1\r\n" * 2000
    assert found(false + parts[0]) == (["0"], [(0, len(false))])


def test_long_and_folded_headers():
    uri = "http://host/" + "a" * (2 << 20)
    part = record(1, b"x").replace(b"Content-Type", f"WARC-Target-URI: {uri}\r\nX-Note: one\r\n two\r\nContent-Type".encode())
    kinds = list(warc.salvage(part + record(2, b"y")))
    assert [k[0] for k in kinds] == ["record", "record"]
    assert kinds[0][3]["warc-target-uri"] == uri and kinds[0][3]["x-note"] == "one two"


def test_every_byte_is_in_a_record_or_a_gap():
    rng = random.Random(4)
    parts = [gzip.compress(record(n, bytes(rng.choices(range(256), k=60)))) if n % 2 else record(n, b"p" * n) for n in range(12)]
    whole = bytearray(b"".join(parts))
    for _ in range(60):
        data = bytearray(whole)
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        at = 0
        for _, start, end, *_ in warc.salvage(bytes(data)):
            assert start == at and end > start
            at = end
        assert at == len(data)


def want(rows, least=0):
    first = {}
    for page, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, html in rows:
        data = (html or "").encode()
        smallest = first.get(data)
        revisit = smallest is not None and smallest != page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", smallest if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", ((900, 7), (1200, 3)))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = warc.round_trip(pages, str(tmp_path / "a"))
    assert sorted(map(str, map(tuple, got.collect()))) == want([(r["page_id"], r["html"]) for r in pages.collect()])


def test_odd_pages(spark, tmp_path):
    rows = [(3, "u", "same"), (1, None, "same"), (1, "v", "same"), (2, "w", None), (4, "x", ""), (None, "y", "same"), (None, "z", "é\r\n\r\nWARC/1.1\r\n" * 3), (9, "big", "x" * 300_000), (-5, "a\r\nb", "q"), (6, "c", "q")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' AS digest", "1 AS first")
    for k, least in enumerate((0, 3)):
        got = warc.round_trip(pages, str(tmp_path / f"b{k}"), least)
        assert sorted(map(str, map(tuple, got.collect()))) == want([(a, c) for a, _, c in rows], least)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "c")).count() == 0


def test_long_url_and_revisits_of_other_writers(spark, tmp_path):
    long_url = "http://h/" + "p" * (2 << 20)
    pages = spark.createDataFrame([(1, long_url, "one"), (2, "u", "one"), (3, None, "z" * (5 << 20))], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "f"))
    assert len({p.parent for p in (tmp_path / "f").glob("*/part-*")}) == 3
    found = warc.read_archives(spark, str(tmp_path / "f"))
    assert sorted((r["record_id"], r["payload_length"]) for r in warc.resolved(found).collect()) == [
        ("<urn:x-page:1>", 3), ("<urn:x-page:2>", 3), ("<urn:x-page:3>", 5 << 20)
    ]
    lost = warc.resolved(found.where("warc_type = 'revisit'")).collect()
    assert [r["payload_length"] for r in lost] == [None]


def test_damaged_file_on_disk(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"payload {i}") for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "d"))
    (tmp_path / "e").mkdir()
    for part in (tmp_path / "d").glob("*/part-*"):
        data = part.read_bytes().replace(b"payload 7", b"payl#ad 7")
        (tmp_path / "e" / "x.warc").write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path / "e")).collect()
    assert len([r for r in rows if r["gap"]]) == 1 and len([r for r in rows if not r["gap"]]) == 19
    assert {r["payload"] for r in rows if not r["gap"]} == {f"payload {i}".encode() for i in range(20) if i != 7}
    shutil.rmtree(tmp_path / "e")

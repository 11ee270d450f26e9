"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing is plain Spark: each record is one text row, the line separator of the text writer is the blank
lines that end a record, so the files are uncompressed WARC files on any store Spark
writes to, committed like every other Spark output.

The reader takes a file's bytes and yields records as long as they check out (version
line, headers, length, the blank lines behind the block, block digest). After a failed check it
looks for the next gzip member or version line from which a record can be read, goes on there, and
logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreloom.llm.registry import query, table
from coreloom.operators.bounded import pin_small
from coreloom.session import materialize, scratch_path

CRLF = "\r\n"
#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT_BYTES = 0
#: One task reads a file back and holds its bytes, so payloads of different sizes go to files of their own: up to so many
#: bytes each, so many records a file. Longer ones share a file as long as they stay below ARCHIVE_BYTES together.
SIZES = ((128 << 10, 2_000), (4 << 20, 64))
ARCHIVE_BYTES = 256 << 20
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Where a record may begin: any version line (junk or a cut record may stand before it on the same line), or a gzip member.
CANDIDATE = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four base32 digits."""
    digest = F.sha1(data)
    groups = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its two closing blank lines; a header whose value is null is left out."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))) for name, value in headers]
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws("", *lines), F.lit(CRLF), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archive files below ``path``.

    Of rows with equal payloads of at least ``min_bytes``, those with the smallest page_id become responses and the
    others revisits that refer to it; null ids come last. Null html is an empty payload. The smallest ids
    come from a grouped minimum over digests, broadcast if small by a checked size, else joined. Files are bounded by
    records and bytes (SIZES, ARCHIVE_BYTES); only a single longer record makes a larger one.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn(
        "bytes", F.octet_length("payload").cast("bigint")
    )
    copied = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1").drop("copies")
    rows = rows.join(pin_small(copied), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    rows = rows.withColumn("revisit", revisit).withColumn(
        "block", F.when(F.col("revisit"), http).otherwise(F.concat(http, "payload"))
    )
    identity = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    record = _record(
        [
            ("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), identity, F.lit(">"))),
            ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block").cast("binary")))),
            ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:x-page:"), F.col("first").cast("string"), F.lit(">")))),
            ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length("block").cast("string")),
        ],
        F.col("block"),
    )
    stored = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes")) + F.coalesce(F.octet_length("url"), F.lit(0))
    rows = rows.select(record.alias("value"), stored.alias("stored"))
    sizes = pages.select((F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0))).alias("size"))
    longest = sizes.agg(F.max("size")).first()[0] or 0
    above = -1
    for k, (most, records) in enumerate((*SIZES, (longest, max(1, ARCHIVE_BYTES // max(1, longest))))):
        if k == 0 or longest > above:
            some = rows.where((F.col("stored") > above) & (F.col("stored") <= most)).select("value")
            some.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records).text(f"{path}/size{k}")
        above = max(above, most)


class Damaged(ValueError):
    """A record or member that fails a check."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; Damaged if any check fails."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    headers: dict[str, str] = {}
    here, name = version.end(), ""
    while True:  # a false start ends at the next version line at the latest, since that line is no header
        stop = data.find(b"\r\n", here)
        if stop < 0:
            raise Damaged("headers do not end")
        line, here = data[here:stop], stop + 2
        if not line:
            break
        if line[:1] in (b" ", b"\t") and name:
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        title, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        name = title.strip().decode("utf-8", "replace").lower()
        if name in headers and name != "warc-concurrent-to":  # the one field that may repeat
            raise Damaged("a header repeats: two records run into each other")
        headers[name] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damaged("no length")
    start = here
    end = start + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block is cut or its length is wrong")
    block = data[start:end]
    if (told := headers.get("warc-block-digest")) and told.startswith("sha1:") and told != _sha1(block):
        raise Damaged("block digest differs")
    return headers, block, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``; Damaged if it is cut or its checksum is wrong."""
    inflate = zlib.decompressobj(31)
    parts, here = [], at
    try:
        while not inflate.eof:
            piece = data[here : here + 65536]
            if not piece:
                raise Damaged("member is cut")
            parts.append(inflate.decompress(piece))
            here += len(piece)
    except zlib.error as error:
        raise Damaged(f"member: {error}") from None
    return b"".join(parts), here - len(inflate.unused_data)


def salvage(data: bytes) -> Iterator[tuple]:
    """Yields ``("record", start, end, headers, block)`` and ``("gap", start, end, reason, None)``, in file order.

    Offsets are the file's own. Records inside one gzip member get the member's offsets; a member
    that holds a damaged record is salvaged by itself, and what it loses is a gap of the member.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                content, end = _member(data, at)
                found = list(salvage(content)) if content else []
                if content and not any(f[0] == "record" for f in found):
                    raise Damaged("member holds no record")
                found = [(kind, at, end, *rest) for kind, _, _, *rest in found]
            else:
                headers, block, end = _parse(data, at)
                found = [("record", at, end, headers, block)]
        except Damaged as failed:
            if gap is None:
                gap, reason = at, str(failed)
            later = CANDIDATE.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason, None


FOUND = (
    "path string, start bigint, end bigint, gap string, warc_type string, record_id string, refers_to string, "
    "target_uri string, payload_digest string, payload_length bigint, payload binary"
)


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        _, _, body = block.partition(b"\r\n\r\n")
        return body
    return block


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of every file below ``path`` (``gap`` is null for records).

    ``path, start, end`` say where; for records also type, ids, payload digest, payload length and, if ``payloads``, the
    payload. Digest and length are computed from the payload; a revisit has the digest its headers state and no
    length (see :func:`resolved`). One task reads a whole file. A response whose payload does not fit its stated digest is a gap.
    """
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                out, size = [], 0
                for row in rows_of(name.as_py(), content.as_py()):
                    out.append(row)
                    size += len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def rows_of(name, content):
        for kind, start, end, what, block in salvage(content):
            row = dict.fromkeys(arrow.names)
            row.update(path=name, start=start, end=end)
            if kind == "gap":
                row["gap"] = what
            else:
                body = _payload(what, block)
                told = what.get("warc-payload-digest", "")
                full = what.get("warc-type") != "revisit"
                if full and told.startswith("sha1:") and told != _sha1(body):
                    row["gap"] = "payload digest differs"
                else:
                    row.update(
                        warc_type=what.get("warc-type"), record_id=what.get("warc-record-id"),
                        refers_to=what.get("warc-refers-to"), target_uri=what.get("warc-target-uri"),
                        payload_digest=(_sha1(body) if full else told).removeprefix("sha1:"),
                        payload_length=len(body) if full else None,
                        payload=body if payloads and full else None,
                    )
            yield row

    arrow = pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("warc_type", pa.string()),
         ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
         ("payload_length", pa.int64()), ("payload", pa.binary())]
    )
    return files.mapInArrow(read, FOUND)


def resolved(found: DataFrame) -> DataFrame:
    """Records of :func:`read_archives` with each revisit's payload length taken from the response it refers to.

    The response must have the id the revisit refers to and the digest it states; if it is lost, the length stays null. Responses that are
    referred to are broadcast if small by a checked size, else joined. ``found`` is read twice: pass a written table.
    """
    revisit = F.coalesce(F.col("warc_type") == "revisit", F.lit(False))
    same = ["refers_to", "payload_digest"]
    asked = found.where(revisit).select(*same).distinct()
    stored = found.where(~revisit).groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_length").alias("stored_length")
    )
    told = pin_small(stored.join(asked, same, "left_semi"))
    length = F.when(revisit, F.col("stored_length")).otherwise(F.col("payload_length"))
    return found.join(told, same, "left").withColumn("payload_length", length).select(*found.columns)


def round_trip(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` below ``path`` and describe what the reader finds there, one row per record.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Repeated page ids keep a record
    each; an empty table writes no record.
    """
    write_archives(pages, path, min_bytes)
    found = read_archives(pages.sparkSession, path, payloads=False).where("gap IS NULL").drop("target_uri", "payload", "gap")
    found = resolved(materialize(found, "records"))

    def page(column: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({column}, '^<urn:x-page:(-?[0-9]+)>$', 1) AS bigint)")

    return found.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


_GROUPS = " || ".join(
    f"lpad(to_base(CAST('0x' || substr(digest, {1 + 5 * i}, 5) AS BIGINT), 32), 4, '0')" for i in range(8)
)
SQL = f"""
WITH stored AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
marked AS (
  SELECT page_id, payload, sha1(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first FROM stored)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  translate({_GROUPS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM marked
"""


@query("op7_warc_salvage", SQL)
def op7(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))

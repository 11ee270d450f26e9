"""Site-relative line removal: drop lines that a large part of a host's pages share.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it
divided by all pages of the host; lines beyond ``RATIO`` go, wherever they stand on a page. A page
adds each of its lines once, so at most (mean lines per page) / RATIO lines of a host can
exceed it: the list of a host's boilerplate is short by construction, and is looked up
in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreloom.llm.names import unused
from coreloom.llm.registry import query, table
from coreloom.llm.text import words
from coreloom.operators.bounded import pin_small

#: A line goes if more than this share of its host's pages have it, and at least MIN_PAGES of them.
RATIO = 0.1
MIN_PAGES = 5
#: Documents of a large mixed source: the share of its different texts by the least number of words of the line.
#: Short lines repeat by chance, long ones never do. Shares are from sf0.1 (README).
DOCUMENT_RATIOS = ((0, 0.02), (4, 0.01), (20, 0.001))

#: What is taken out of a page, and which tags end a line.
HIDDEN = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
BREAKS = r"(?i)</?(?:html|head|title|body|nav|ul|ol|li|div|article|section|header|footer|main|aside|table|tr|td|th|h[1-6]|p|br|hr|pre|blockquote|form)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """Lower-case host of an address; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def visible_lines(html: Column) -> Column:
    """Lines of a page's visible text, trimmed, without empty ones."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    broken = F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(broken, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host, _dropped``: the md5 sums of the lines to drop, one row per host that has any.

    ``pages`` has ``_host`` and ``_lines`` (array of text). Counts start in the task that reads a page and
    only 16-byte sums are shuffled; rare lines leave before they meet the host totals.
    """
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    sums = F.array_distinct(F.transform("_lines", lambda x: F.unhex(F.md5(x))))
    counted = pages.select("_host", F.explode(sums).alias("_line")).groupBy("_host", "_line").agg(
        F.count(F.lit(1)).alias("_with")
    )
    often = counted.where(F.col("_with") >= min_pages).join(pin_small(totals), "_host")
    return often.where(F.col("_with") > F.col("_pages") * F.lit(ratio)).groupBy("_host").agg(
        F.collect_list("_line").alias("_dropped")
    )


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` (``_host``, ``_lines`` and any others) with ``_kept``: the lines that stay, in order.

    Every row stays, also if all its lines go. Repeated rows count as often as they occur. The lists
    of the hosts are broadcast if small by a checked size, else joined by host (skewed hosts are split).
    """
    gone = unused(pages.columns, "_dropped")
    lists = pin_small(boilerplate(pages, ratio, min_pages).withColumnRenamed("_dropped", gone))
    none = F.array().cast("array<binary>")
    return (
        pages.join(lists, "_host", "left")
        .withColumn(gone, F.coalesce(gone, none))
        .withColumn("_kept", F.filter("_lines", lambda x: ~F.array_contains(F.col(gone), F.unhex(F.md5(x)))))
        .drop(gone)
    )


def document_boilerplate(docs: DataFrame, ratios: tuple[tuple[int, float], ...], min_pages: int) -> DataFrame:
    """Like :func:`boilerplate`, counting different texts (``_mark``), with the ratio of the line's number of words.

    Copies of a text count once, so that a text that is copied often does not lose its lines in all copies.
    """
    totals = docs.groupBy("_host").agg(F.count_distinct("_mark").alias("_pages"))
    lines = F.array_distinct(
        F.transform("_lines", lambda x: F.struct(F.unhex(F.md5(x)).alias("sum"), F.size(words(x)).alias("words")))
    )
    found = docs.select("_host", "_mark", F.explode(lines).alias("_l"))
    found = found.select("_host", "_mark", F.col("_l.sum").alias("_line"), F.col("_l.words").alias("_words"))
    counted = found.groupBy("_host", "_line", "_words").agg(F.count_distinct("_mark").alias("_with"))
    often = counted.where(F.col("_with") >= min_pages).join(pin_small(totals), "_host")
    ratio = F.lit(None).cast("double")
    for least, share in sorted(ratios):
        ratio = F.when(F.col("_words") >= least, F.lit(share)).otherwise(ratio)
    return often.where(F.col("_with") > F.col("_pages") * ratio).groupBy("_host").agg(
        F.collect_list("_line").alias("_dropped")
    )


def clean_documents(docs: DataFrame, ratio: float | None = None, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines of their ``source`` taken out of ``text``; ``n_chars`` follows.

    ``ratio`` holds for all lines; without it DOCUMENT_RATIOS do. Blank lines are no lines: they stay where they
    are. Null texts and sources stay null (null sources are one group).
    """
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], "source", "text")
    split = inner.select(
        *[f"c{i}" for i in range(len(names))],
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"),
        F.split("text", "\n").alias("_all"),
        F.xxhash64("text").alias("_mark"),
    )
    lined = split.withColumn(
        "_lines", F.filter(F.coalesce("_all", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    )
    ratios = DOCUMENT_RATIOS if ratio is None else ((0, ratio),)
    lists = pin_small(document_boilerplate(lined, ratios, min_pages))
    joined = lined.join(lists, "_host", "left").withColumn(
        "_dropped", F.coalesce("_dropped", F.array().cast("array<binary>"))
    )
    text = F.array_join(
        F.filter("_all", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_dropped"), F.unhex(F.md5(x)))), "\n"
    )
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("bigint")}
    return joined.withColumn("_text", text).select(
        *[new[c].alias(c) if c in new else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    )


SQL = f"""
WITH split AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'),
      chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS n FROM split GROUP BY host),
counted AS (
  SELECT host, line, count(*) AS k
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM split) GROUP BY host, line),
dropped AS (
  SELECT host, list(line) AS bad FROM counted JOIN totals USING (host)
  WHERE k >= {MIN_PAGES} AND k > n * CAST({RATIO} AS DOUBLE) GROUP BY host),
kept AS (
  SELECT page_id, split.host, lines,
    list_filter(lines, lambda x: NOT list_contains(coalesce(bad, CAST([] AS VARCHAR[])), x)) AS kept
  FROM split LEFT JOIN dropped ON split.host = dropped.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  md5(coalesce(array_to_string(kept, chr(10)), '')) AS kept_md5
FROM kept
"""


@query("op5_site_line_dedup", SQL)
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", host(F.col("url")).alias("_host"), visible_lines(F.col("html")).alias("_lines")
    )
    return without_boilerplate(pages).select(
        "page_id",
        F.col("_host").alias("host"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("bigint").alias("n_dropped"),
        F.md5(F.array_join("_kept", "\n")).alias("kept_md5"),
    )

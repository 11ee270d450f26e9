import pytest
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
INNER = ["_mark", "_class", "_slot", "_n", "_h", "cutoffs", "_dropped", "_node_at", "_words", "_lines", "_windows", "_positions",
         "_stratum", "_whole", "_id", "_own", "_rest", "_group", "_length", "c0", "c1", "_rank", "_place"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, repeated, tied and long rows, and columns whose names clash with inner ones."""
    long_text = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "s0"),
        (2, "alpha beta gamma delta epsilon zeta", "en", "s0"),
        (2, "alpha beta gamma delta epsilon zeta", "en", "s0"),
        (3, None, "de", None),
        (4, "", None, "s1"),
        (None, "one word after another, and É", "fr", "s1"),
        (None, None, None, None),
        (5, "x", "en", "s1"),
        (6, " \t\n ", "en", "s1"),
        (7, long_text, "en", "s2"),
        (8, "x" * 50000, "en", "s2"),
        (9, "a\nb\n\na\nb  c d\x0be 😀 <|endoftext|> ▁x", "en", "s2"),
    ]
    return spark.createDataFrame(
        [Row(doc_id=a, text=b, lang=c, source=d, n_chars=len(b) if b is not None else None, ids="q", _row="r", shard="s", fingerprint=3.5, rule="z", stratum="y", **dict.fromkeys(INNER, "own"))
         for a, b, c, d in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, _row string, shard string, fingerprint double, rule string, stratum string, " + ", ".join(f"{c} string" for c in INNER),
    )


@pytest.fixture(scope="session")
def sf():
    return SF

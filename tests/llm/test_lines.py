"""Boilerplate lines of documents, and odd pages (the pages query is checked by its SQL)."""

from coreloom.llm import lines


def test_lines_of_a_source_go(spark):
    rows = [(i, f"shared line\nown {i}\n\nshared line\nlast {i % 2}" if i < 20 else f"only {i}\nshared line", "en", "a" if i < 20 else "b", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r for r in lines.clean_documents(docs, ratio=0.6).collect()}
    assert len(out) == 120
    assert out[3]["text"] == "own 3\n\nlast 1" and out[3]["n_chars"] == len(out[3]["text"])
    assert out[50]["text"] == "only 50"
    rare = {r["doc_id"]: r["text"] for r in lines.clean_documents(docs, ratio=0.6, min_pages=21).collect()}
    assert rare[3] == rows[3][1] and rare[50] == "only 50"


def test_odd_documents(spark, odd_docs):
    out = lines.clean_documents(odd_docs.unionAll(odd_docs))
    assert out.columns == odd_docs.columns and out.count() == 2 * odd_docs.count()
    again = {r["doc_id"]: r["text"] for r in out.collect()}
    assert again[3] is None and again[4] == "" and again[6] == " \t\n "
    assert lines.clean_documents(odd_docs.limit(0)).count() == 0


def test_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "HTTP://User@A.com:80/x", "<p>One<br>Two <b>x</b></p><script>p('</p>')</script>"), (2, "http://a.com", ""), (None, "nothing", "<!-- <p>a</p> -->text")],
        "page_id bigint, url string, html string",
    )
    got = pages.select("page_id", lines.host(pages.url).alias("h"), lines.visible_lines(pages.html).alias("l")).collect()
    assert [tuple(r) for r in got] == [(1, "", []), (2, "a.com", ["One", "Two x"]), (2, "a.com", []), (None, "", ["text"])]


def test_default_shares_of_a_large_source(spark):
    medium, long = "one line of some six words", " ".join(f"word{i}" for i in range(25))
    rare = " ".join(f"rare{i}" for i in range(25))
    texts = [f"own text number {i}\nlast {i}" for i in range(1000)]
    for i in range(15):
        texts[i] += f"\n{medium}\nYes."
    for i in range(100, 106):
        texts[i] += f"\n{long}"
    for i in range(200, 203):
        texts[i] += f"\n{rare}"
    texts += ["a text of many words that is copied\nwhole and often"] * 40
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r["text"] for r in lines.clean_documents(docs).collect()}
    assert out == {i: t.replace(f"\n{medium}", "").replace(f"\n{long}", "") for i, t in enumerate(texts)}

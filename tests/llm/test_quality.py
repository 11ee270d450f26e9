"""Base counts and binomial cutoffs against brute force."""

import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from coreloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark, sf, odd_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        got = [tuple(r) for r in quality.measure(docs).select("doc_id", *quality.BASE, "base_failed").collect()]
        want = [(r["doc_id"], *brute(r["text"])) for r in docs.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def binomial_most(n, alpha, level):
    total, most = 0.0, -1
    for k in range(n + 1):
        logs = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        total += math.exp(logs + k * math.log(alpha) + (n - k) * math.log(1 - alpha))
        if total > level:
            break
        most = k
    return most


def test_allowed_rejections(spark):
    sizes = [0, 1, 10, 149, 150, 200, 500, 1000, 5000]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    for alpha, level in ((0.02, 0.05), (0.02, 0.01), (0.1, 0.05)):
        got = {r[0]: r[1] for r in df.select("n", quality.allowed_rejections(F.col("n"), alpha, F.lit(level))).collect()}
        assert got == {n: binomial_most(n, alpha, level) if n else -1 for n in sizes}
    large = spark.range(1).select(quality.allowed_rejections(F.lit(3_000_000).cast("bigint"), 0.02, F.lit(0.05))).first()[0]
    assert abs(large - (60_000 - 1.645 * math.sqrt(3_000_000 * 0.02 * 0.98))) < 5


def labelled(spark, n, bad_from=0.5):
    ok = "plain words make a calm text with no signs at all and some more of them here to be long enough ".split()
    rows, labels = [], []
    for i in range(n):
        words = [f"{ok[(i * 7 + k) % len(ok)]}{(i + k * k) % 97}" for k in range(60)]
        bad = i % 5 == 0
        if bad:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else None))
        labels.append((i, 0 if bad else 1, 0))
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_certified_rules_reject_the_bad_and_keep_the_good(spark):
    docs, labels = labelled(spark, 4000)
    kept = {r["doc_id"] for r in quality.filter_good(docs, labels).collect()}
    good = [i for i in range(4000) if i % 5]
    assert not [i for i in range(0, 4000, 5) if i in kept]
    assert sum(i not in kept for i in good) <= quality.ALPHA * len(good)


def test_few_or_no_labels_reject_nothing_more(spark, odd_docs):
    docs, labels = labelled(spark, 200)
    assert quality.filter_good(docs, labels).count() == 200
    assert quality.filter_good(docs, labels.limit(0)).count() == 200
    kept = quality.filter_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == 0
    none = labels.select(F.lit(None).cast("bigint").alias("doc_id"), "quality", "toxic")
    assert quality.filter_good(docs, none).count() == 200


def test_rows_stay_rows(spark):
    docs, labels = labelled(spark, 300)
    twice = docs.unionAll(docs)
    measured = quality.measure(twice)
    out = quality.judge(measured, quality.calibrate(measured, labels.unionAll(labels)))
    assert out.count() == 600 and out.where("kept IS NULL").count() == 0


def verdicts(rows, labels):
    """kept per doc_id, from the measured rows, by plain loops over the method's steps."""
    quality_of = {}
    for doc, mark in labels:
        quality_of[doc] = min(mark, quality_of.get(doc, mark))
    strata = {}
    for r in rows:
        if not r["base_failed"] and r["doc_id"] in quality_of:
            held = zlib.crc32(f"quality:{r['doc_id']}".encode()) % 2 == 1
            values = [r[m] for m in quality.METRICS]
            strata.setdefault(r["lang"] or "", []).append((held, quality_of[r["doc_id"]] == 1, values))
    with_grid = {s: own for s, own in strata.items() if any(g and not h for h, g, _ in own)}
    chosen = {}
    for s, own in with_grid.items():
        fit = [v for h, g, v in own if g and not h]
        best = None
        for level, share in enumerate(quality.LEVELS):
            at = max(0, math.ceil((1.0 - share) * len(fit)) - 1)
            cut = [sorted(v[i] for v in fit)[at] for i in range(len(quality.METRICS))]
            out = [(h, g, any(x > c for x, c in zip(v, cut))) for h, g, v in own]
            n, k = sum(h and g for h, g, _ in out), sum(h and g and o for h, g, o in out)
            if k > binomial_most(n, quality.ALPHA, quality.DELTA / len(with_grid)) or not n:
                break
            good, bad = [o for h, g, o in out if g and not h], [o for h, g, o in out if not g and not h]
            gain = sum(bad) / max(1, len(bad)) - sum(good) / max(1, len(good))
            if best is None or gain > best[0]:
                best = (gain, cut)
        if best:
            chosen[s] = best[1]
    return {
        r["doc_id"]: not r["base_failed"]
        and not any(r[m] > c for m, c in zip(quality.METRICS, chosen.get(r["lang"] or "", [math.inf] * len(quality.METRICS))))
        for r in rows
    }, chosen


def test_verdicts_recomputed(spark):
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(6000):
        noise = rng.random() ** 4
        words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 9))) + ("#!" if rng.random() < noise else "") for _ in range(rng.randint(40, 90))]
        docs.append((i, " ".join(words), rng.choice(["en", "de", None, "xx"]) if i % 40 else "rare"))
        if rng.random() < 0.8:
            labels.append((i, int(rng.random() > noise)))
    labels += [(d, 0) for d, _ in labels[:50]]  # a second label, the worst of which counts
    measured = quality.measure(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(measured, quality.calibrate(measured, marks)).collect()}
    want, chosen = verdicts(measured.collect(), labels)
    assert chosen and "rare" not in chosen
    assert got == want and 0.02 < 1 - sum(want.values()) / len(want) < 0.9

"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (a given list, and word stems that the labels show to be
toxic), how often their words stand near a second person, capitals, punctuation, and signs of
obfuscation (digits and signs inside words, stretched letters). A bounded sample of labelled rows is split by a
hash of the id: one part finds stems, one fits the trees, one calibrates their scores. Every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreloom.llm.pieces import _Cache
from coreloom.llm.registry import query, table
from coreloom.session import materialize

#: Labelled rows that take part in fitting: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Word beginnings kept, their lengths, and the evidence (log-likelihood ratio) and lift one needs.
STEMS = 2_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
SHORTEST = 3
EVIDENCE = 16.0
LIFT = 3.0
NEAR_WORDS = 4
THRESHOLD = 0.7
TREES, DEPTH, STEP = 30, 3, 0.2
CACHED_WORDS = 300_000
LONGEST_CACHED = 40

#: Common English insults; a parameter of :func:`features`.
LEXICON = (
    "idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless disgusting "
    "clown clowns ugly jerk bastard bitch crap damn hell hate kill die shut pig rat vermin filth filthy liar coward"
).split()
#: Second persons in a few languages.
SECOND = (
    "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros vuestro tus"
).split()
UNMASK = str.maketrans("013457@$!", "oieastasi")

FEATURES = (
    "listed", "learned", "any_listed", "any_learned", "second", "near_second", "capitals", "shouted_words", "exclaims",
    "punctuation", "obfuscated", "obfuscated_hits", "length",
)


EDGES = ".,;:!?\"'()[]{}"
STRETCHED = re.compile(r"([^\W\d_])\1\1+")


def plain(word: str) -> str:
    """Lower case without signs, with look-alike digits undone and stretched letters shortened."""
    core = word.strip(EDGES)
    if core.isalpha():
        flat = core.lower()
    else:
        core = word.lower().strip(EDGES + "*-_|#%&<>$@")
        undone = core.translate(UNMASK) if re.search("[^\\W\\d_]", core) else core
        flat = re.sub(r"[\W_]", "", undone)
    return STRETCHED.sub(r"\1", flat)


def stems(word: str) -> tuple[str, ...]:
    """The word's beginnings of STEM_LENGTHS letters, and the whole word if it is short."""
    flat = plain(word)
    return tuple({flat[:k] for k in STEM_LENGTHS}) if len(flat) >= 3 else ()


def words(text: str | None) -> list[str]:
    return text.split() if text else []


def _marker(lexicon: frozenset, learned: frozenset, second: frozenset):
    """Packs what matters of one word into an integer: flags, and counts of letters and signs."""

    first = frozenset(s[:SHORTEST] for s in learned)

    def mark(word: str) -> int:
        core = word.strip(EDGES)
        flat = plain(word)
        if core.isalpha():
            letters = len(core)
            signs = len(word) - letters
            inner = len(flat) != len(core.lower())
        else:
            letters = sum(map(str.isalpha, word))
            signs = len(word) - sum(map(str.isalnum, word))
            inner = bool(letters) and bool(re.search(r"[\d@$!*_]", core)) or bool(STRETCHED.search(word.lower()))
        upper = 0 if word.islower() else sum(map(str.isupper, word))
        return (
            (flat in lexicon)
            | (flat[:SHORTEST] in first and not learned.isdisjoint(stems(word))) << 1
            | (core.lower() in second) << 2
            | (letters > 1 and upper == letters) << 3
            | inner << 4
            | min(upper, 255) << 8
            | min(signs, 255) << 16
            | min(word.count("!") + word.count("?"), 255) << 24
            | min(len(word), 65535) << 32
        )

    return mark


def excess(found: list[str]) -> tuple[int, int, int, int]:
    """Capitals, signs, exclamations and characters of the words beyond what their marks can hold."""
    out = [0, 0, 0, 0]
    if max(map(len, found), default=0) > 255:
        for word in found:
            if len(word) > 255:
                counts = sum(map(str.isupper, word)), len(word) - sum(map(str.isalnum, word)), word.count("!") + word.count("?")
                for i, (count, most) in enumerate(zip((*counts, len(word)), (255, 255, 255, 65535))):
                    out[i] += max(0, count - most)
    return tuple(out)


_MARKS: dict[tuple, _Cache] = {}


def _marks(sets: tuple[frozenset, frozenset, frozenset]) -> _Cache:
    """The worker's remembered words, of the latest lexicons."""
    if sets not in _MARKS:
        _MARKS.clear()
        _MARKS[sets] = _Cache(_marker(*sets), CACHED_WORDS, LONGEST_CACHED)
    return _MARKS[sets]


def row_features(marks: np.ndarray, beyond: tuple[int, int, int, int] = (0, 0, 0, 0)) -> list[float]:
    """FEATURES of a text from the marks of its words and their :func:`excess`; a text without words is all zeros."""
    n = len(marks)
    if not n:
        return [0.0] * len(FEATURES)
    listed, learned = (marks & 1).astype(bool), (marks >> 1 & 1).astype(bool)
    second = (marks >> 2 & 1).astype(bool)
    hits = listed | learned
    near = 0
    if hits.any() and second.any():
        spots, at = np.flatnonzero(second), np.flatnonzero(hits)
        right = np.searchsorted(spots, at)
        gap = np.minimum(
            np.abs(spots[np.minimum(right, len(spots) - 1)] - at), np.abs(spots[np.maximum(right - 1, 0)] - at)
        )
        near = int((gap <= NEAR_WORDS).sum())
    hidden = (marks >> 4 & 1).astype(bool)
    upper, signs, exclaims, more = beyond
    chars = max(1, int((marks >> 32).sum()) + more)
    return [
        listed.sum() / n, learned.sum() / n, np.log1p(listed.sum()), np.log1p(learned.sum()), second.sum() / n, near / n,
        (int((marks >> 8 & 255).sum()) + upper) / chars, (marks >> 3 & 1).sum() / n, (int((marks >> 24 & 255).sum()) + exclaims) / n,
        (int((marks >> 16 & 255).sum()) + signs) / chars, hidden.sum() / n, (hidden & hits).sum() / n, np.log1p(n),
    ]


def features(docs: DataFrame, learned: list[str], lexicon=tuple(LEXICON), text: str = "text", name: str = "_features") -> DataFrame:
    """Attach ``name`` (array<double>, order of FEATURES); one pass, no shuffle, whole texts. The text goes."""
    import pyarrow as pa

    names = [c for c in docs.columns if c not in (text, name)]
    sets = frozenset(lexicon), frozenset(learned), frozenset(SECOND)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _marks(sets)
        for batch in batches:
            rows = []
            for value in batch.column(len(names)):
                found = words(value.as_py())
                marks = np.fromiter(map(cache.__getitem__, found), np.int64, len(found))
                rows.append(row_features(marks, excess(found)))
            column = pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], column], [*inner, "features"])

    inner = [f"c{i}" for i in range(len(names))]
    schema = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(names))
    out = docs.select(*[F.col(c).alias(i) for c, i in zip(names, inner)], F.col(text).alias("text"))
    out = out.mapInArrow(compute, schema + "features array<double>")
    return out.select(*[F.col(i).alias(c) for c, i in zip(names, inner)], F.col("features").alias(name))


def _stems(rows: DataFrame) -> DataFrame:
    """Each text's different stems, one row each: ``_label, stem``."""
    import pyarrow as pa

    def compute(batches):
        cache = _Cache(stems, CACHED_WORDS // 4, LONGEST_CACHED)
        for batch in batches:
            labels, found = [], []
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = set().union(*map(cache.__getitem__, set(words(value.as_py()))))
                labels += [label] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.string())], ["_label", "stem"])

    return rows.select(F.col("_label").cast("int"), "text").mapInArrow(compute, "_label int, stem string")


def learn_stems(rows: DataFrame) -> list[str]:
    """At most STEMS stems that far more toxic than other texts contain (``_label``, ``text``)."""
    n = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        return []
    counts = _stems(rows).groupBy("stem").agg(F.count_if(F.col("_label") == 1).alias("a"), F.count_if(F.col("_label") == 0).alias("b"))
    a, b = F.col("a"), F.col("b")
    share = (a + b) / F.lit(float(toxic + other))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(F.lit(0.0))

    evidence = 2 * (
        part(a, share * toxic) + part(b, share * other) + part(toxic - a, (1 - share) * toxic) + part(other - b, (1 - share) * other)
    )
    lift = ((a + 0.5) / (toxic + 1.0)) / ((b + 0.5) / (other + 1.0))
    best = counts.where((lift >= LIFT) & (evidence >= EVIDENCE)).orderBy(evidence.desc(), "stem").limit(STEMS)
    return sorted(r["stem"] for r in best.select("stem").collect())


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id's decimal text, modulo 3; null ids get null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


class Model:
    """Stems, trees and calibration; constant if the labels show one class or none."""

    def __init__(self, learned: list[str], trees, calibration, constant: float):
        self.learned, self.trees, self.calibration, self.constant = learned, trees, calibration, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` without ``text``, with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on)."""
        rows = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
        if self.trees is None:
            out = rows.drop("text").withColumn("score", F.lit(self.constant))
        else:
            names = [c for c in rows.columns if c != "text"]
            rows = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], "text")
            rows = features(rows, self.learned).withColumn("_features", array_to_vector("_features"))
            rows = self.calibration.transform(self.trees.transform(rows))
            out = rows.select(
                *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)],
                F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0)).alias("score"),
            )
        return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled ids outside the held-out third (:func:`fold` is 1).

    Rows without id or label count for nothing, several labels of an id as the worst. The sample is the ids
    with the smallest hashes; it is broadcast, so texts without a sampled label never move.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != 1)
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    chosen = (
        usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("_label"))
        .withColumn("_part", F.pmod(order, F.lit(10)).cast("int"))
        .orderBy(order, "doc_id")
        .limit(fit_rows)
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = materialize(rows.select("doc_id", "_label", "_part", "text"), "labelled")
    seen = {r["_part"]: (r["ones"], r["n"]) for r in rows.groupBy("_part").agg(F.sum("_label").alias("ones"), F.count(F.lit(1)).alias("n")).collect()}

    def both(parts) -> bool:
        ones, n = (sum(seen.get(p, (0, 0))[i] for p in parts) for i in (0, 1))
        return 0 < ones < n

    ones, n = (sum(v[i] for v in seen.values()) for i in (0, 1))
    if not both(range(10)):
        return Model([], None, None, ones / n if n else 0.0)
    # A sample too small to show both classes in each part is used whole in every step.
    enough = both(range(5)) and both(range(5, 8)) and both(range(8, 10))
    part = F.col("_part")
    found, grown, held_back = (part < 5, part.between(5, 7), part > 7) if enough else (F.lit(True),) * 3
    learned = learn_stems(rows.where(found))
    fitted = materialize(features(rows.where(grown | held_back), learned), "features").withColumn(
        "_features", array_to_vector("_features")
    ).withColumn("_label", F.col("_label").cast("double"))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7,
        predictionCol="_class", cacheNodeIds=False,
    ).fit(fitted.where(grown))
    held = trees.transform(fitted.where(held_back))
    calibration = IsotonicRegression(
        featuresCol="probability", featureIndex=1, labelCol="_label", predictionCol="_calibrated"
    ).fit(held.select("probability", "_label"))
    return Model(learned, trees, calibration, ones / n)


def filter_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    model = fit(docs, labels)
    names = docs.columns
    kept = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], "text")
    scored = model.score(kept).where("predicted = 0")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


@query("op9_boosted_toxicity")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")

"""Row-level expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(probs: Column) -> Column:
    """Shannon entropy (natural log) of a probability array; a zero adds nothing."""
    return F.aggregate(
        probs,
        F.lit(0.0),
        lambda acc, p: acc + F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0)),
    )


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean norm of the difference of two arrays."""
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
        )
    )


def hash_order(key: Column, seed: int = 42) -> Column:
    """Seeded, engine-independent shuffling key: 32 hexadecimal digits of an md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(order: Column, digits: int = 3) -> Column:
    """Leading hex digits of a shuffling key: 16**digits buckets that sort like the key."""
    return F.substring(order, 1, digits)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0 (the zero-division rule of the scores)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0)))


def clean(value: Column, digits: int = 6) -> Column:
    """Round for reports and turn -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def pick(array: Column, indices: list[int]) -> Column:
    """Elements of an array at the given 0-based positions, in that order."""
    if not indices:
        return F.array().cast("array<double>")
    return F.transform(F.lit(list(indices)), lambda i: F.get(array, i))

"""64-bit SimHash: terms vote on every bit with their hash.

The votes of a document are counted by a grouped sum that starts in the task that
reads the document: 32 sums of two 32-bit lanes each (bits k and k + 32), so neither
the document's terms nor 64 columns are ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 0x0000000100000001
LOW = 0xFFFFFFFF


def vote_sums(term_hash: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates over a document's terms; a null hash votes for nothing."""
    out = []
    for k in range(32):
        lane = F.shiftrightunsigned(term_hash, k).bitwiseAND(F.lit(LANES))
        out.append(F.sum(lane if weight is None else lane * weight).alias(f"_v{k}"))
    total = F.count(term_hash) if weight is None else F.sum(F.when(term_hash.isNotNull(), weight))
    return [*out, total.cast("bigint").alias("_votes")]


def majority() -> Column:
    """The fingerprint: bit b is 1 if over half the votes set it; no votes give 0."""
    bits = []
    for b in range(64):
        lane = F.col(f"_v{b % 32}")
        count = F.shiftrightunsigned(lane, 32) if b >= 32 else lane.bitwiseAND(F.lit(LOW))
        value = 1 << b if b < 63 else -(1 << 63)
        bits.append(F.when(count * 2 > F.col("_votes"), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda a, c: a.bitwiseOR(c), bits)


def hex64(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - distance(a, b) / 64.0

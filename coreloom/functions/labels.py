"""Label domains: text label <-> integer class code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class codes of the two applications.
ANOMALY_CODES = {
    "None": 0,
    "pagefail": 1,
    "leak": 2,
    "ddot": 3,
    "memeater": 4,
    "dial": 5,
    "cpufreq": 6,
    "copy": 7,
    "ioerr": 8,
}
APPLICATION_CODES = {
    "Kripke": 0,
    "AMG": 1,
    "PENNANT": 2,
    "linpack": 3,
    "LAMMPS": 4,
    "Quicksilver": 5,
    "None": 6,
}


def encode(label: Column, codes: dict[str, int]) -> Column:
    """Class code of a text label; null when the label is not in the domain."""
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(codes.items())])
    return F.try_element_at(lookup, label.cast("string"))


def decode(code: Column, codes: dict[str, int]) -> Column:
    """Text label of a class code; null when the code is not in the domain."""
    lookup = F.create_map(*[F.lit(v) for name, c in codes.items() for v in (c, name)])
    return F.try_element_at(lookup, code.cast("int"))


def domain_table(spark: SparkSession, codes: dict[str, int]) -> DataFrame:
    """The domain as a table (label int, name string)."""
    return spark.createDataFrame(
        [(c, n) for n, c in codes.items()], "label int, name string"
    )

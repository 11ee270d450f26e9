"""Words and shingles as array expressions, all evaluated inside the JVM.

A word is a run of characters other than space, tab, line feed, vertical tab, form
feed and carriage return, in whole texts; null texts have no words.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what separates words.
GAP = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def shingles(words: Column, size: int) -> Column:
    """Runs of ``size`` words joined by spaces, repeats included; fewer words make one run, none none.

    ``words`` must be a column, not an expression: it is read once per shingle.
    """
    n = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))),
        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]),
    )
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))

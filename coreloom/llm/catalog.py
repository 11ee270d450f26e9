"""Imports every operator's module, so that its queries are registered."""

from coreloom.llm import (  # noqa: F401
    chat,
    exact,
    fingerprints,
    lines,
    neardup,
    negatives,
    packing,
    pieces,
    quality,
    search,
    sharding,
    toxicity,
    warc,
)
from coreloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

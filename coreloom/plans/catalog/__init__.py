"""Every registered query; importing this package fills the registry."""

from coreloom.plans.catalog import (  # noqa: F401
    facts,
    metrics,
    models,
    profiles,
    selection,
    series,
    similarity,
    splits,
    tables,
    workflows,
)
from coreloom.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

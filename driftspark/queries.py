"""Queries of __spark_entry__.py and the SQL that says the same."""

from __future__ import annotations

from driftspark.plans import deep, meshes, models, observed  # noqa: F401  they register their queries
from driftspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

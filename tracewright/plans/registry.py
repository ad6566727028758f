"""All queries of the library outside the llm subpackage, with their SQL."""

from __future__ import annotations

from tracewright.plans import distribution_queries, generate_queries, mining_queries, profile_queries, source_queries, workflow  # noqa: F401
from tracewright.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

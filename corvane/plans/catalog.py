"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from corvane.plans import code, evaluation, graphs, ingestion, overview, retrieval
from corvane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "evaluation", "graphs", "ingestion", "overview", "retrieval"]

"""The query catalogue: each query by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from . import oracles, queries_more, queries_rows, queries_sequences, queries_statistics, queries_study
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "oracles", "queries_more", "queries_rows", "queries_sequences", "queries_statistics", "queries_study"]

"""Registered queries for the operators on annotated data, with the SQL that must give the same rows."""

from __future__ import annotations

from . import checks, columns, live, merges, pictures, quality, relations, scans, streams, summaries  # noqa: F401
from .base import QUERIES, SQL

FLAGSHIP = "class_counts"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

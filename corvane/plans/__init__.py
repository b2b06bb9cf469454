"""Registered queries and their SQL."""

from __future__ import annotations

from . import catalogue, clusters, labels, learning, metrics, relational, scans, selection, text, vectors  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

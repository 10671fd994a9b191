"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from strideline import queries_form, queries_markets, queries_sources, queries_state  # noqa: F401  they register themselves
from strideline.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

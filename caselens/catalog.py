"""The registered queries of the library and the SQL that states the same results."""

from __future__ import annotations

from caselens.queries import behavior, clean, detect, ingest, ml, rules, sop, stats, textbatch, views  # noqa: F401
from caselens.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Queries of the library over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from plantwatch.registry.book import ORACLES, QUERIES

for _part in ("fleet", "rules", "summaries", "frames", "ranking", "scenes", "modelruns", "reports", "models", "streams", "storage", "landing"):
    import_module(f"plantwatch.registry.{_part}")

__all__ = ["ORACLES", "QUERIES"]

"""All queries of the analytics operators."""

from __future__ import annotations

from . import dataset_queries, fragment_queries, interval_queries, topic_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

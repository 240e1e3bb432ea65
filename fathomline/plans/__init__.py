"""The registered queries of the engine."""

from . import code, retrieval, scans, summaries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

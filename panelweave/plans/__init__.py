"""The query catalogue."""

from . import comparisons, documents, panels, statistics
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "comparisons", "documents", "panels", "statistics"]

"""Runnable queries over the given tables."""

from pagesift.catalog import documents, following, history, pages, scalars  # noqa: F401
from pagesift.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

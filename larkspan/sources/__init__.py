"""Readers for the input tables."""

from larkspan.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]

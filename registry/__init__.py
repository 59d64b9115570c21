"""Queries over the star-schema tables: one per operator, with the SQL that an
independent engine uses to check it."""

from registry import catalog, events, ingest, joins, reports, series, stats, text  # noqa: F401
from registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

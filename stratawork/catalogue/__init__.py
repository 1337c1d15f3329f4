"""Registered queries: what each operator does on the test tables, next to the same result in SQL."""

from . import dimensions, loading, monitoring, quality, staging, star
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

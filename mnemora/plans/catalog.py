"""All registered queries."""

from . import ingest, recall, relational, streams  # noqa: F401  (they register)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

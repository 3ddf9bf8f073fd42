"""All queries of the library by name."""

from __future__ import annotations

from . import accounting, corpus, evaluation, learning  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

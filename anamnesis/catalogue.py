"""All driver queries of the store and their SQL."""

from __future__ import annotations

from anamnesis import queries_sources, queries_steps  # noqa: F401  (they register their queries)
from anamnesis.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Operators for large training-text pipelines, with their driver queries.

Nothing outside this package imports it; ``queries()`` and ``oracle_sql()`` are
what the entry module asks for.
"""

from __future__ import annotations


def queries() -> dict:
    """Driver queries of all operators here, by name."""
    from anamnesis.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL for those of the queries that SQL can express."""
    from anamnesis.llm.registry import ORACLES

    return dict(ORACLES)

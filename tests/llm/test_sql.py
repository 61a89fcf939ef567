"""Queries with SQL give what DuckDB gives."""

import pytest

from anamnesis.llm import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(name, spark, sf, duck):
    frame = queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    result = duck.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())

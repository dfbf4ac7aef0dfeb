"""Queries that SQL can express, on the smallest tables."""

import pytest

from loomline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_all_are_registered():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in registry.QUERIES)] == []

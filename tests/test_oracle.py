"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import pytest

from framelake.plans import registry

from .conftest import table

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert registry.entry(spark, sf).count() > 0

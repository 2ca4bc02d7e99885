from __future__ import annotations

import pytest
from parity import SF, duck_rows, rows_of

from lakesearch import catalog

ROWS_ONLY = [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == duck_rows(duck, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

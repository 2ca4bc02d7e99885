from __future__ import annotations

import pytest
from parity import SF, duck_rows, rows_of

from lakesearch.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows_of(Q.QUERIES[name](spark, SF)) == duck_rows(duck, Q.ORACLE_SQL[name])

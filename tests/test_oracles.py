"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from conftest import DATA, rows_of

from dialoom import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    got = catalog.queries()[name](spark, DATA)
    sql = catalog.oracle_sql().get(name)
    frame = got.toPandas()
    if sql is None:
        assert len(frame)
        return
    assert rows_of(frame) == rows_of(duck.execute(sql).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

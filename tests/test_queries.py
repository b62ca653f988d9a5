"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables(folder):
    return connect(folder)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, tables, name):
    df = QUERIES[name](spark, folder)
    if name in ORACLES:
        notes = [n for n in differences(df, tables, ORACLES[name]) if n != "empty result"]
        assert not notes, notes
    else:
        assert df.count() > 0

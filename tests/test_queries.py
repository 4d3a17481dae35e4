"""Every registered query of the reference-style operators, against its SQL where there is some."""

import pytest
from comparison import oracle_rows, rows_of

from plumbline.queries import ORACLES, QUERIES


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows_of(df, columns)
    if name in ORACLES:
        assert got == oracle_rows(sf_dir, ORACLES[name], columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

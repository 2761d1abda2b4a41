"""Every registered query of the library against its SQL."""

import pytest

from compare import connect, rows_of, rows_of_sql
from tessera import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    names, got = rows_of(plans.QUERIES[name](spark, sf_dir))
    want_names, want = rows_of_sql(con, plans.ORACLE[name])
    assert names == want_names
    assert got == want


def test_every_sql_has_a_query():
    assert set(plans.ORACLE) <= set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

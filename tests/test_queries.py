"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from fathom import registry

from oracle import SF, spark_rows, sql_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert spark_rows(df) == sql_rows(SQL[name])
    else:
        assert df.collect()


def test_entry_and_names():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())

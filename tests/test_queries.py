"""Every query of the library's own operators: rows against SQL where there is some, else that there are rows."""

import pytest

from folioflow.queries import ORACLE, QUERIES
from tests.compare import SF, of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_sql(spark, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_duckdb(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

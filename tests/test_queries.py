"""Every registered query of the library against its SQL, and the entry point."""

import pytest

import __spark_entry__
import compare
from loamgrid import catalog_of_queries as own


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.views(sf_dir)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query(spark, con, sf_dir, name):
    said = compare.compared(spark, con, name, sf_dir)
    assert said in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE_SQL)))
def test_without_sql(spark, sf_dir, name):
    assert __spark_entry__.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

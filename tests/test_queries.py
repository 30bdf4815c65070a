"""Every query of the engine's own operators against its SQL, and the driver's contract."""

import pytest
from conftest import SMALL

import __spark_entry__ as driver
from loomwright.plans import queries as impact


@pytest.mark.parametrize("name", list(impact.QUERIES))
def test_equals_sql(name, same):
    assert same(impact.QUERIES[name], impact.SQL[name], SMALL) >= 0


def test_entry(spark):
    assert {"o_orderkey", "n_hit", "gated"} == set(driver.entry(spark).columns)


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())

"""Every registered query against its SQL in DuckDB, on the smallest given tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cohortspark.plans.oracles import ORACLES
from cohortspark.plans.queries import QUERIES
from compare import differences, tables

SF = "/root/testdata/sf0.001"
#: The smallest tables leave rows that a fit predicts exactly, which the SQL of these does not look for.
LARGER, LARGER_SF = {"adjusted_odds", "births_set_aside", "estimates", "score_equations"}, "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return tables(SF)


def test_every_oracle_has_a_query():
    assert oracle_sql().keys() <= queries().keys()
    assert QUERIES.keys() <= queries().keys()
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - LARGER))
def test_query(spark, connection, name):
    assert differences(spark, connection, name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(LARGER))
def test_query_of_larger_tables(spark, name):
    assert differences(spark, tables(LARGER_SF), name, QUERIES[name], ORACLES[name], LARGER_SF) is None

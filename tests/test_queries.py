"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from check import DATA, compare, duck
from flowguard.plans import catalog, oracles

FOLDER = f"{DATA}/sf0.001"
QUERIES, ORACLES = catalog.queries(), oracles.oracle_sql()

# The only query whose result is empty on the smallest tables.
EMPTY = {"w09_jumps_above_floor"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER, may_be_empty=name in EMPTY)
    assert not problem, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["node_id", "level", "n"]
    assert df.count() == 24

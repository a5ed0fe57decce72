"""Every registered query next to its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, con, name):
    text, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert text.startswith("ok"), text


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_names_are_unique_and_paired():
    assert set(ORACLES) <= set(QUERIES)

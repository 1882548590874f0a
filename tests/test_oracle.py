"""Every registered query against its DuckDB oracle at sf0.01 (row count, columns, value hash)."""

import os

import pytest

import __spark_entry__ as entry
from chatlake.plans.check import compare, duckdb_connection
from chatlake.plans.oracle import ORACLES
from chatlake.plans.queries import QUERIES
from tests.conftest import SF001

pytestmark = pytest.mark.skipif(not os.path.isdir(SF001), reason="test data missing")

_Q = QUERIES  # the optional subpackage's queries have tests of their own
_SQL = ORACLES


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF001)


@pytest.mark.parametrize("name", sorted(_Q))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF001, name, _Q[name], _SQL.get(name), con)
    if name in _SQL:
        assert r["cols_match"], r
        assert r["spark_rows"] == r["oracle_rows"], r
        assert r["hash_match"], r


def test_every_query_has_oracle():
    assert set(_Q) - set(_SQL) == set()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["term", "weight", "rel_weight"]
    assert df.count() > 0

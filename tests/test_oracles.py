"""Every query that SQL can state gives the SQL's rows on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import compare, duck  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    status, _, note = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    spark.catalog.clearCache()
    assert status == "ok", note


def test_entry_returns_rows(spark):
    out = entry_module.entry(spark)
    assert set(out.columns) == {"lang", "n", "accuracy", "f1_macro"}
    assert out.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from rackpulse import catalog

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")

SQL = entry.oracle_sql()
ROWS_ONLY = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


@pytest.fixture(scope="module")
def database():
    return oracle.database(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
    assert ROWS_ONLY == ["decision_tree", "logistic_regression", "random_forest", "svr_linear", "svr_poly", "svr_rbf"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, database, name):
    assert oracle.compare(entry.queries()[name](spark, FOLDER), database, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

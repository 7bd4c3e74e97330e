"""Each operator is registered once, and the queries with SQL equal it."""

import re

import corpus_pipeline
import oracle
import pytest

import __spark_entry__ as entry
from rackpulse.llm import catalog

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in catalog.queries()]
    assert sorted(numbers) == list(range(1, 14))
    assert set(catalog.queries()) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(catalog.oracle_sql()) <= set(entry.oracle_sql())


def test_stages_are_callable():
    assert all(callable(f) and isinstance(name, str) for name, f in corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.compare(catalog.queries()[name](spark, FOLDER), oracle.database(FOLDER), catalog.oracle_sql()[name]) is None

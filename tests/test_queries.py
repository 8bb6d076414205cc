import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
TWINS = oracle_sql()
QUERIES = queries()
# Trained models have no SQL twin; the ones here stand for the rest, which test_models.py covers.
ROWS_ONLY = ["train_compare", "feature_importance", "explain_tree", "background_summary"]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["cp", "target", "count"]
    assert entry(spark).count() == 8


@pytest.mark.parametrize("name", sorted(TWINS))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, TWINS[name]) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0

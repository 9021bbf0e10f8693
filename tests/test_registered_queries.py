"""Every registered query against its DuckDB counterpart."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = os.environ.get("STUDY_DIR", "/root/testdata/sf0.001")
CORPUS = set(entry.corpus_queries())
QUERIES, SQL = ({k: v for k, v in found.items() if k not in CORPUS} for found in (entry.queries(), entry.oracle_sql()))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the parquet tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck.sql(SQL[name])) is None


def test_flagship(spark):
    assert entry.entry(spark).count() == 5

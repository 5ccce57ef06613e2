"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from compare import check, connect

from quillspark.catalog.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert check(spark, db, QUERIES[name], FOLDER) is None


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()

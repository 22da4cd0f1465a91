"""Every query with SQL against DuckDB over whole tables of the smallest folder; skipped where the folder is missing."""

import os

import pytest

pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    ok, what = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, what

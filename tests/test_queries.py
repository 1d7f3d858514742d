"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from corvane.queries import QUERIES, SQL

from . import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = compare.spark_rows(QUERIES[name](spark, FOLDER))
    if name in SQL:
        want = compare.sql_rows(con, SQL[name])
        assert got[0] == want[0]
        assert got[1] == want[1]
    else:
        assert got[1]

"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SMALL = "/root/testdata/sf0.001"
# nothing in the smallest tables satisfies these; larger ones are compared by hand
MAY_BE_EMPTY = {"placeholder_images", "forget_repo"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SMALL).count() > 0
        return
    report = compare(spark, con, fn, sql, SMALL)
    assert report is None or (name in MAY_BE_EMPTY and report == "both sides are empty"), report


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo_id", "phase", "file_ord", "path", "kind", "value"]
    assert df.count() > 0

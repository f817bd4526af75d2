from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codecensus.session import settle
    from tests.oracle import make_spark

    session = settle(make_spark("4"))
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted rows of a frame as tuples, in the order of the named columns."""
    def collect(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)

    return collect

"""Every registered query against its SQL at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import compare, connect  # noqa: E402

from wishgrid.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 140


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    ok, info = compare(spark, con, sf, name)
    assert ok, info

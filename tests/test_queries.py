"""Every registered query with a SQL twin gives the twin's result."""

from __future__ import annotations

import pytest

from tests.oracle import compare, connect
from wardlight.checks.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)


# Results that are rightly empty on the smallest tables.
MAY_BE_EMPTY = {"resolve_complaints"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, sf_dir, name):
    result = compare(spark, con, sf_dir, name)
    if name in MAY_BE_EMPTY and result == "empty result":
        return
    assert result is None, result

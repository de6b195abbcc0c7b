"""Queries and their twins agree on keys that the supplied tables are too small for."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.oracle import compare, connect
from wardlight.checks.views import TABLES


@pytest.fixture(scope="module")
def shifted(sf_dir, tmp_path_factory):
    """The smallest tables, with their customers and events once more under keys from 1,000,000 on."""
    folder = str(tmp_path_factory.mktemp("shifted"))
    keys = {"customer": "c_custkey", "events": "event_id"}
    for table in TABLES:
        source = f"{sf_dir}/{table}.parquet"
        if table not in keys:
            os.symlink(source, f"{folder}/{table}.parquet")
            continue
        key = keys[table]
        duckdb.sql(
            f"SELECT * FROM '{source}' UNION ALL SELECT * REPLACE ({key} + 1000000 AS {key}) FROM '{source}' ORDER BY {key}"
        ).write_parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", ["gen_seed", "get_complaint", "resolve_complaints"])
def test_twin(spark, shifted, name):
    assert compare(spark, connect(shifted), shifted, name) is None

"""Compare registered queries with their SQL twins: ``python tests/oracle.py <sf dir> [name ...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pyarrow as pa

from wardlight.checks.registry import QUERIES, SQL
from wardlight.checks.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_value(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None if equal, else what differs."""
    mine = QUERIES[name](spark, sf_dir).toArrow()
    other = con.execute(SQL[name]).to_arrow_table()
    if sorted(mine.column_names) != sorted(other.column_names):
        return f"columns {sorted(mine.column_names)} / {sorted(other.column_names)}"
    kinds = [
        (n, str(mine.schema.field(n).type), str(other.schema.field(n).type)) for n in mine.column_names
        if str(mine.schema.field(n).type).replace("large_", "") != str(other.schema.field(n).type).replace("large_", "")
    ]
    if kinds:
        return f"types {kinds}"
    a, b = rows_of(mine), rows_of(other)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows, first {wrong[0]}"
    return None if a else "empty result"


def main() -> None:
    from wardlight.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    for name in names:
        start = time.time()
        if name not in SQL:
            print(f"{name}: rows {QUERIES[name](spark, sf_dir).count()} (no SQL) {time.time() - start:.1f}s", flush=True)
            continue
        try:
            result = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{name}: {'ok' if result is None else result} {time.time() - start:.1f}s", flush=True)


if __name__ == "__main__":
    main()

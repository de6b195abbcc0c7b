"""Line dedup against SQL on supplied tables and a plain version on odd ones."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from tests.oracle import connect, rows_of
from wardlight.llm import line_dedup
from wardlight.llm.registry import QUERIES, SQL

COMMON = "This line is Common to many documents"
WHITE = " \t\n\x0b\f\r"
ODD = [
    (1, f"{COMMON}\nown line one\n", "a"), (2, f"  {COMMON.upper()}\t\n\n{COMMON}", "b"), (3, f"x\n{COMMON}\r\n{COMMON}", None),
    (3, f"y\n{COMMON}", "c"), (None, f"{COMMON}\nno id", "d"), (4, None, "e"), (5, "", "f"), (5, "", "f"),
    (0, "\n".join([COMMON, "short", "É" + "ä" * 30] * 20_000), "g"), (7, "É" + "ä" * 30, "h"), (8, "é" + "ä" * 30, "i"),
    (9, "exactly nineteen ch", "j"), (10, "exactly nineteen ch", "k"), (11, "exactly nineteen ch", "l"), (2, f" {COMMON}", "m"),
]


def low(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least_documents=3, least_chars=20):
    """(doc_id, lines, dropped, kept text) by dictionaries."""
    keys = [[low(line.strip(WHITE)) for line in (r[1] or "").split("\n")] for r in rows]
    held = defaultdict(list)
    for r, ks in zip(rows, keys):
        for k in set(ks):
            if len(k) >= least_chars:
                held[k].append(r[0])
    keeper = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= least_documents}
    out = []
    for r, ks in zip(rows, keys):
        lines = (r[1] or "").split("\n")
        kept = [line for line, k in zip(lines, ks) if k not in keeper or keeper[k] == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, drop string").withColumnRenamed("drop", "a")


def digests(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def expected(rows):
    return sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain(rows)), key=repr)


def test_twin(spark, sf_dir):
    mine = QUERIES["op13_line_dedup"](spark, sf_dir).toArrow()
    other = connect(sf_dir).execute(SQL["op13_line_dedup"]).to_arrow_table()
    assert rows_of(mine) == rows_of(other)
    assert any(n for n in mine.column("n_dropped").to_pylist())


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_rows": 3}])
def test_odd_rows(spark, options):
    """Nulls, empty, very long and repeated texts, shared ids; each way of joining gives the same."""
    df = frame(spark, ODD)
    assert digests(line_dedup.line_digests(df, **options)) == expected(ODD)
    whole = line_dedup.without_repeated_lines(df, **options)
    assert whole.schema == df.schema
    texts = [None if r[1] is None else p[3] for r, p in zip(ODD, plain(ODD))]
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(((r[0], t, r[2]) for r, t in zip(ODD, texts)), key=repr)


def test_clashing_columns(spark):
    """Columns named like those inside stay as they are."""
    df = frame(spark, ODD[:5]).selectExpr("doc_id", "text", "'1' AS h", "2 AS doc", "3 AS `drop`", "4 AS b", "5 AS row", "6 AS a", "7 AS `n.x`")
    whole = line_dedup.without_repeated_lines(df)
    assert whole.schema.names == df.schema.names
    assert {tuple(r)[2:] for r in whole.collect()} == {("1", 2, 3, 4, 5, 6, 7)}
    assert digests(line_dedup.line_digests(df)) == expected(ODD[:5])


def test_empty_table(spark):
    assert line_dedup.line_digests(frame(spark, [])).count() == 0
    assert line_dedup.without_repeated_lines(frame(spark, [])).count() == 0


LINES = st.lists(st.sampled_from(["ab", "AB ", "cde", "\tCDE", "", "f g h", "É"]), min_size=0, max_size=6).map("\n".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), LINES)), min_size=1, max_size=8))
def test_any_rows(spark, rows):
    rows = [(*r, "") for r in rows]
    got = line_dedup.without_repeated_lines(frame(spark, rows), 2, 2).collect()
    texts = [None if r[1] is None else p[3] for r, p in zip(rows, plain(rows, 2, 2))]
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(((r[0], t) for r, t in zip(rows, texts)), key=repr)

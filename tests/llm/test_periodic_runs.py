"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from wardlight.llm import periodic_runs as pr
from wardlight.llm.registry import QUERIES
from wardlight.llm.tables import load


def plain_runs(words, length=24, exponent=3):
    """Every maximal stretch of every period, of which the smallest period counts."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(length, exponent * q):
                best.setdefault((i, size), q)
            i = max(j, i) + 1
    return sorted(((i, s, q) for (i, s), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def found(texts, **options):
    got = pr.runs_by_text(pa.array(texts, pa.string()), **options)
    return [got.get(i, []) for i in range(len(texts))]


WORDS = st.one_of(
    st.lists(st.sampled_from("ab"), max_size=40),
    st.lists(st.sampled_from("abc"), max_size=60),
    st.tuples(st.lists(st.sampled_from("abcde"), min_size=1, max_size=9), st.integers(1, 9), st.lists(st.sampled_from("abc"), max_size=9)).map(
        lambda t: t[2] + t[0] * t[1] + t[2]
    ),
).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=6), st.sampled_from([(24, 3), (6, 3), (4, 2), (12, 4), (1, 2)]))
def test_runs_of_any_texts(texts, least):
    length, exponent = least
    assert found(texts, length=length, exponent=exponent) == [plain_runs(t.split(), length, exponent) for t in texts]


def test_known_runs():
    """Nested, overlapping and neighbouring runs; the same run in many texts; a word of white space of another kind."""
    inner = "x " * 24
    texts = [
        inner, "a b c " * 8, ("y " + inner) * 4, "a b " * 12 + "b a " * 12, "a b c " * 7 + "a b c", "a b " * 11 + "a",
        *["p q r s " * 9] * 50, "a b " * 24, "\t\n\v\f\r" .join(["a b"] * 12), "",
    ]
    assert found(texts) == [plain_runs(t.encode().split()) for t in texts]
    assert found(["x " * 24]) == [[(0, 24, 1)]]


def test_long_texts():
    """Time grows with the length also where one word fills the text, or two texts alternate."""
    start = time.perf_counter()
    assert found(["z " * 200_000]) == [[(0, 200_000, 1)]]
    rng = np.random.default_rng(1)
    unit = " ".join(map(str, rng.integers(0, 500, 40_000)))
    assert found([f"0 {unit} {unit} {unit} {unit}"])[0][-1:] != []
    assert time.perf_counter() - start < 60


ODD = [
    (1, "a b " * 40, "a"), (None, "a b " * 40, None), (2, None, "c"), (3, "", "d"), (3, " \n ", "e"), (1, "a b " * 40, "a"), (1, "other words", "f"),
    (4, "long text of five words " * 20_000, "g"), (-5, "x " * 30 + "tail", "h"), *((i, "one two three four five six " * 6 + str(i), "i") for i in range(40, 90)),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, runs string")


def plain_long(doc_id, text):
    return plain_row(doc_id, text) if len(text or "") < 10_000 else None


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated ids and rows."""
    got = sorted(map(tuple, pr.run_digests(odd(spark)).collect()), key=repr)
    assert len(got) == len(ODD)
    long = [r for r in got if r[0] == 4]
    assert long[0][1:6] == (1, 0, 100_000, 5, 20_000_000)
    assert [r for r in got if r[0] != 4] == sorted((plain_row(r[0], r[1]) for r in ODD if r[0] != 4), key=repr)
    rows = pr.periodic_runs(odd(spark)).filter("doc_id = -5").collect()
    assert [tuple(r) for r in rows[0]["runs"]] == [(0, 30, 1)] and rows[0]["text"].endswith("tail")


def test_clashing_columns(spark):
    whole = pr.without_periodic_runs(odd(spark).selectExpr("doc_id", "text", "runs", "1 AS start", "2 AS words"))
    assert whole.schema.names == ["doc_id", "text", "runs", "start", "words"]
    rows = whole.collect()
    assert len(rows) == len(ODD) and {tuple(r)[3:] for r in rows} == {(1, 2)}
    assert {r["text"] for r in rows if r["doc_id"] in (-5, 2, 3)} == {"x tail", None, "", " \n "}


def test_empty_table(spark):
    assert pr.run_digests(odd(spark, [])).count() == 0
    assert pr.periodic_runs(odd(spark, [])).count() == 0
    assert pr.without_periodic_runs(odd(spark, [])).count() == 0


def test_supplied_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").collect()
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, sf_dir).collect()))
    assert got == sorted(plain_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] for r in got) > 5

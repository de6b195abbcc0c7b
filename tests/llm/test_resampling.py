"""Importance resampling against SQL on supplied tables and a plain version on odd ones."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tests.oracle import connect, rows_of
from wardlight.llm import resampling as rs, textarrays as ta
from wardlight.llm.registry import QUERIES, SQL

LONG = "Very long " * 30_000
ODD = [
    (1, "One two, three-four 5six Ünïcode " * 5, "a"), (2, "a b c " * 20, None), (3, None, "c"), (4, "", "d"), (5, "x" * 300 + " y", "e"),
    (None, "no id at all " * 9, "f"), (None, "no id at all " * 9, "g"), (2, "a b c " * 20, "h"), (2, "a b c d " * 20, "i"), (7, LONG, "j"),
    (-(2**62), "low id " * 15, "k"), (2**62, "high id " * 15, "l"), (8, "nineteen " * 19, "m"), (9, "...,,,", "n"), (10, "twenty " * 20, "o"),
]
TARGET = [("one two three",), (None,), ("",), ("a b",)]


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(rows, target, percent=25, least_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for r in rows for f in features(r[1])[1])
    t = Counter(bucket(f) for r in target for f in features(r[0])[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    scored = []
    for r in rows:
        words, fs = features(r[1])
        g = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in map(bucket, fs)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        scored.append((len(words), r[0], len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in scored if x[0] >= least_words), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2]))
    drawn = len(fit) * percent // 100
    out = [(*x[1:], i + 1 if i < drawn else None) for i, x in enumerate(fit)]
    return out + [(*x[1:], None) for x in scored if x[0] < least_words]


def frames(spark, rows, target=TARGET):
    return spark.createDataFrame(rows, "doc_id long, text string, rank string"), spark.createDataFrame(target, "text string")


def same(df, wanted):
    assert sorted(map(tuple, df.drop("print").collect()), key=repr) == sorted(wanted, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(" aB1ü😀.\n-"), max_size=30), st.just("q" * 200 + " r"))))
def test_buckets_of_any_texts(texts):
    for block in ta.blocks(pa.array(texts, pa.string())):
        one, two, first, pairs = rs._features(block, 10_000)
        for i, text in enumerate(texts[block.first : block.last]):
            mine = [*one[first[i] : first[i + 1]], *two[pairs[i] : pairs[i + 1]]]
            assert mine == [zlib.crc32(f.encode()) % 10_000 for f in features(text)[1]]


def test_twin(spark, sf_dir):
    mine = QUERIES["op12_resampling"](spark, sf_dir).toArrow()
    assert rows_of(mine) == rows_of(connect(sf_dir).execute(SQL["op12_resampling"]).to_arrow_table())


@pytest.mark.parametrize("options", [{}, {"block_rows": 3, "digit_bits": 5}, {"block_rows": 2, "digit_bits": 8, "broadcast_bytes": 0}])
def test_odd_rows(spark, options):
    """Nulls, empty and very long texts, equal scores, shared ids; any size of block and digit."""
    documents, target = frames(spark, ODD)
    same(rs.resampled(documents, target, 60, **options), plain(ODD, TARGET, 60))


def test_many_blocks(spark):
    """Ties of a third of all rows, over many blocks."""
    rng = np.random.default_rng(3)
    rows = [(int(i) if i % 3 else 5, "a b " * 12 + ("c " * int(rng.integers(9)) if i % 3 else ""), "") for i in rng.permutation(900)]
    documents, target = frames(spark, rows)
    same(rs.resampled(documents, target, block_rows=50, digit_bits=7), plain(rows, TARGET))


def test_drawn_documents(spark):
    """All columns stay, also those named like columns inside."""
    documents, target = frames(spark, ODD)
    documents = documents.selectExpr("doc_id", "text", "rank", "1 AS a", "2 AS print", "3 AS row", "4 AS score")
    got = rs.drawn_documents(documents, target, percent=60)
    assert got.schema.names == documents.schema.names
    drawn = {(d, n) for d, n, _, _, k in plain(ODD, TARGET, 60) if k}
    wanted = Counter(r for r in ODD if (r[0], len(features(r[1])[1])) in drawn)
    assert Counter(tuple(r)[:3] for r in got.collect()) == wanted


@pytest.mark.parametrize("rows, target", [([], TARGET), (ODD[:3], []), ([], [])])
def test_empty_tables(spark, rows, target):
    documents, other = frames(spark, rows, target)
    same(rs.resampled(documents, other), plain(rows, target))
    assert rs.drawn_documents(documents, other).count() == 0

"""Chat, licences, n-gram join, decontamination and the pipeline against SQL and brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import connect, rows_of
from wardlight.llm import chat, decontamination as dc, licenses, ngram_join as nj
from wardlight.llm.registry import QUERIES, SQL
from wardlight.llm.tables import load
from wardlight.workspace import Workspace


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf_dir, name):
    mine, other = QUERIES[name](spark, sf_dir).toArrow(), connect(sf_dir).execute(SQL[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(other.column_names)
    assert rows_of(mine) == rows_of(other) and mine.num_rows


def _grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(docs):
    sets = {d: _grams(t) for d, t in docs}
    name = {d: d for d in sets}

    def top(d):
        while name[d] != d:
            d = name[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and sets[a] and sets[b] and 100 * both >= 75 * either:
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {(d, len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(spark, seed):
    """Chains of edits around the threshold, groups of copies and shared passages."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(20))
    docs, n = [], 0
    for family in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 90]))]
        for _ in range(14):
            words = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            docs.append((n, " ".join(words) + (" " + passage if rng.random() < 0.5 else "")))
            n += 1
    docs += [(n, ""), (n + 1, None), (n + 2, "Short one"), (n + 3, "short  ONE"), (n + 4, passage), (n + 5, "É é"), (n + 6, "é é")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in nj.near_duplicates(df).collect()} == _components(docs)


class _Tables(Workspace):
    """Keeps the written tables."""

    def __init__(self, spark):
        super().__init__(spark)
        self.tables = {}

    def write(self, df, label):
        self.tables[label] = super().write(df, label)
        return self.tables[label]


def test_copies_alone_are_not_compared(spark):
    """Equal sets are one class, and only classes with other partners are compared."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8)]
    near = texts[0].replace("w0x59", "edited")
    docs = [(k, t) for k, t in enumerate(texts * 3)] + [(100, near), (101, None), (None, texts[1])]
    ws = _Tables(spark)
    out = nj.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), workspace=ws)
    assert {r["node"] for r in ws.tables["survivors"].collect()} == {0, 100}
    mine = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.filter("doc_id is not null").collect()}
    assert mine == _components(docs[:-1])


def test_only_texts_that_share_are_searched():
    """A text without any n-gram of an item gets no signatures; the pairs found stay the same."""
    item = " ".join(f"i{j}" for j in range(30))
    texts = ["", "no such words in here at all", f"before {item} after", None, "i1 i2 i3", item]
    items = dc.Items(*dc._item_sets([(7, item)], 5))
    (block,) = dc.ta.blocks(pa.array(texts, pa.string()))
    grams = dc.ta.shingles(*block.words(), 5)
    assert items.sharing(*grams).tolist() == [2, 5]
    assert items.candidates(*grams) == {(2, 0), (5, 0)}
    assert dc.Items([], []).candidates(*grams) == set()


def test_distinct_hashes():
    hashes = np.array([3, 1, 3, 1, 1, 9, 9], np.uint64)
    out, begins = dc.ta.distinct(hashes, np.array([0, 0, 3, 5, 5, 7, 7]))
    assert out.tolist() == [1, 3, 1, 9] and begins.tolist() == [0, 0, 2, 3, 3, 4, 4]
    assert hashes.tolist() == [3, 1, 3, 1, 1, 9, 9]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[40:], rng.integers(0, 2**63, 55, dtype=np.uint64)])
    s = nj._odd_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert 0 < sum(int(x ^ y & -1).bit_count() if (x ^ y) >= 0 else int((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(*s.tolist())) <= 95


def test_near_copies_of_odd_rows(spark):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (1, "other text here and there", 0), (2, "a b c d e f", 0),
            (None, "a b c d e f", 0), (3, None, 0), (4, "y " * 30_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = Counter(tuple(r) for r in nj.near_duplicates(df).collect())
    assert got == Counter({(1, 2, 1): 2, (1, 1, 1): 1, (2, 2, 1): 1, (None, 2, None): 1, (3, 0, 3): 1, (4, 1, 4): 1})
    assert nj.near_duplicates(df.limit(0)).count() == 0
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, None, 3, 4])


def test_items_inside_long_documents(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"q{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 9, 24, 60, 200])))) for i in range(60)]
    docs = []
    for i in range(150):
        words = [f"d{rng.randrange(3000)}" for _ in range(rng.randrange(50, 6000))]
        for _ in range(2):
            own = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1])):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = own
        docs.append((i, " ".join(words)))
    docs += [(900, items[0][1]), (901, None), (902, ""), (None, items[1][1])]
    items += [(70, None), (71, ""), (72, items[3][1]), (None, "x")]
    want = set()
    for d, t in docs:
        grams = _grams(t)
        for i, s in items:
            own = _grams(s)
            if d is not None and i is not None and own and 100 * len(own & grams) >= 75 * len(own):
                want.add((d, i, len(own), len(own & grams)))
    df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in dc.contaminated(df, items_df).collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    kept = {r["doc_id"] for r in dc.without_contaminated(df, items_df).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in got}
    assert dc.contaminated(df.limit(0), items_df).count() == dc.contaminated(df, items_df.limit(0)).count() == 0


def test_items_in_slices(spark, sf_dir, monkeypatch):
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    whole = Counter(map(tuple, dc.contaminated(docs, items).collect()))
    monkeypatch.setattr(dc, "ITEM_GRAMS", 500)
    assert Counter(map(tuple, dc.contaminated(docs, items).collect())) == whole and whole


def test_snapshots(spark):
    rows = [
        (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"),
        (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "x"), (5, 0, "user", "a"), (5, 1, "assistant", "x"),
        (6, 0, None, "a"), (7, 5, "system", None), (None, 0, "user", "z"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n int")
    got = {r["conv_id"]: (r["n_turns"], r["n_snapshots"], r["text"]) for r in chat.collapse_snapshots(df).collect()}
    assert got == {
        3: (3, 1, "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>"),
        4: (2, 2, "<|user|>\na<|end|>\n<|assistant|>\nx<|end|>"), 7: (1, 1, "<|system|>\n<|end|>"), None: (1, 1, "<|user|>\nz<|end|>"),
    }
    assert chat.collapse_snapshots(df.limit(0)).count() == 0


def test_long_conversations_and_ties(spark):
    """50,000 turns in one conversation, equal turn numbers, repeated rows, a long text, and snapshots of all of them."""
    long = [(1, i, "user", f"turn {i}") for i in range(50_000)]
    rows = [*long, *((2, *r[1:]) for r in long[:30_000]), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"),
            (4, 5, "user", "a"), (4, 6, "user", "a"), (5, 0, None, "x" * 500_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["n_snapshots"], len(r["text"])) for r in chat.collapse_snapshots(df).collect()}
    each = len("<|user|>\n" + "<|end|>")
    assert set(got) == {1, 3, 5}
    assert got[1] == (50_000, 1, sum(len(r[3]) + each for r in long) + 49_999)
    assert got[3] == (3, 1, 3 * (each + 1) + 2) and got[5] == (1, 1, 500_000 + each)


def test_short_benchmark_items_make_bounded_slices(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"{i:03}"[:3]) for i in range(1000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{i:03}") for i in range(0, 1000, 50)], "doc_id long, text string")
    monkeypatch.setattr(dc, "ITEM_GRAMS", 10_000)
    slices = list(dc._slices(items, dc.WORDS))
    assert sum(len(s.ids) for s in slices) == 1000 and max(len(s.ids) for s in slices) * 16 * dc.HASHES <= 24 * 10_000
    got = sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect())
    assert got == [(i, i) for i in range(0, 1000, 50)]


def test_licence_rules(spark):
    s = licenses.SENTENCES
    wrapped = s["mt1"].replace("documentation files", "documentation\nfiles").replace("permit persons", "permit\npersons")
    rows = [
        (1, f"x\nCopyright me\n\n{wrapped}\n\n{s['mt2']}\n\n{s['mt3']}"), (2, f"{s['bs0']}\n1. {s['bs1']}\n2. {s['bs2']}\n3. {s['bs3']}"),
        (3, f"{s['bs0']}\n1. {s['bs1']}\n2. {s['bs2']}\nfin"), (4, f"{s['mt0']} {s['ap0'].upper()}"), (5, "licence of my own"),
        (6, None), (6, ""), (7, s["mt0"]), (7, s["mt0"]), (8, "word " * 50_000 + ".\n" + s["cc0"]), (9, s["bs0"]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = sorted((r["doc_id"], r["licenses"], r["n_notices"]) for r in licenses.find_licenses(df).collect())
    assert got == [
        (1, "MIT", 1), (2, "BSD-3-Clause", 1), (3, "BSD-2-Clause", 1), (4, "Apache-2.0,MIT", 2), (5, "", 0), (6, "", 0), (6, "", 0),
        (7, "MIT", 1), (7, "MIT", 1), (8, "CC-BY-NC-4.0", 1), (9, "", 0),
    ]
    assert licenses.find_licenses(df.limit(0)).count() == 0


def test_licence_names_and_parameters(spark):
    # Wordings of public notices, none of them lines of the supplied documents.
    lines = {
        "Licensed under the MIT License.": "MIT", "Released under the Apache License, Version 2.0.": "Apache-2.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0", "This article is shared under the terms of the CC BY-SA 3.0 license": "CC-BY-SA-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 2.5 Generic License.": "CC-BY-NC-SA-2.5",
        "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */": "Apache-2.0 OR MIT",
        "# SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later", "License: BSD-3-Clause": "BSD-3-Clause",
        "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "GPL-2.0-only",
        "This library is licensed under the LGPL v2.1 or later.": "LGPL-2.1-or-later", "Distributed under the AGPLv3": "AGPL-3.0-only",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy": "MPL-2.0",
        "The code is available under the ISC licence, see LICENSE for details": "ISC", "Released under CC0 1.0 Universal.": "CC0-1.0",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        licenses.SENTENCES["gp1"]: "GPL-3.0-or-later", licenses.SENTENCES["gp1"].replace("program", "library").replace("General", "Lesser General"): "LGPL-3.0-or-later",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file)": "BSL-1.0",
        "This is not licensed under the MIT License.": "", "MIT": "", "We released MIT people under the rain": "", "License: mine": "",
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_notices"]) for r in licenses.find_licenses(df).collect()}
    assert {t: got[i] for i, t in enumerate(lines)} == {t: (v, int(v != "")) for t, v in lines.items()}
    own = licenses.find_licenses(
        spark.createDataFrame([(1, "x\nUse it as you like!\nMIT"), (2, "Licensed under the House's Terms 2")], "doc_id long, text string"),
        {"free": "Use it as you like"}, [("Free's", ["free"])], {"House": ["House's Terms 2"]},
    )
    assert sorted(tuple(r) for r in own.collect()) == [(1, "Free's", 1), (2, "House", 1)]


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Extra columns named like those inside stay as they are, through every stage that keeps columns."""
    odd = ["_id", "_key", "_spans", "_toxic_score", "_n", "id", "KEY", "spans", "toxic_score", "n", "row", "node", "label", "score", "a.b"]
    docs = load(spark, sf_dir, "documents")
    docs = docs.filter("doc_id < 60").unionByName(docs.filter("doc_id < 3")).select("*", *[F.lit(f"own {c}").alias(c) for c in odd])
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = Workspace(spark).write(stage(spark, kept, sf_dir), "kept")
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(tuple(r)[-len(odd) :] == tuple(f"own {c}" for c in odd) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).count() >= kept.count()


def test_pipeline_stages(spark, sf_dir):
    """Each stage's decisions, judged on its own input by brute force."""
    docs = load(spark, sf_dir, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf_dir).cache())
    tables = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:-1]]
    assert all(s.columns == docs.columns for s in steps[1:-1])
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op8_toxicity"](spark, sf_dir).collect()}
    assert set(tables[1]) == {d for d, p in scores.items() if not p}
    assert set(tables[2]) == {c for _, _, c in _components(list(tables[1].items()))}
    seen = set()
    for d, text in sorted(tables[2].items()):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]).decode(errors="ignore")
        assert tables[3].get(d) == (kept if kept.strip() or not gone.any() else None)
    items = [_grams(r["text"]) for r in load(spark, sf_dir, "benchmark").collect()]
    clean = {d for d, t in tables[3].items() if not any(100 * len(i & _grams(t)) >= 75 * len(i) for i in items)}
    assert set(tables[4]) == clean
    assert {r["doc_id"] for r in steps[-1].collect()} == clean
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[-1].count()

"""Sharding, packing and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from wardlight.llm import fingerprint as fp, packing, sharding
from wardlight.llm.registry import QUERIES
from wardlight.llm.tables import load

ODD = [
    (5, "one two  three\nfour", "x"), (3, None, "y"), (4, "", "z"), (4, "", "z"), (9, "ä€😀 b", None),
    (None, "no id", "w"), (7, "same", "a"), (8, "same", "b"), (8, "same", "b"), (1, "long " * 60_000, "l"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, row string")


@pytest.mark.parametrize("n", [1, 2, 3, 16, 97, 1000, 4096])
def test_permutation_is_a_bijection(n):
    p = sharding.Permutation(n, seed=3)
    places = p.permute(np.arange(n))
    assert sorted(places) == list(range(n))
    assert (p.restore(places) == np.arange(n)).all()


def test_permutation_mixes():
    places = sharding.Permutation(10_000, seed=1).permute(np.arange(10_000))
    assert abs(np.corrcoef(places, np.arange(10_000))[0, 1]) < 0.05


def test_shards_of_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in load(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op3_sharding"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    by_shard = defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        by_shard[r["shard"]].append(r["slot"])
    assert set(by_shard) == set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    order = sorted(docs)
    for r in rows[:20]:
        assert order[sharding.row_at(r["shard"], r["slot"], len(order))] == r["doc_id"]


def test_shards_of_odd_rows(spark):
    rows = sharding.sharded_documents(odd(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {1}
    assert sharding.sharded_documents(odd(spark, [])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=64, max_size=64), st.integers(0, 2**32 - 1))
def test_plan_uses_every_piece_once(counts, seed):
    histogram = np.array([0, *counts])
    groups = packing.plan(histogram, limit=64, bins=8)
    used = np.zeros(65, int)
    for n, lengths in groups:
        assert n > 0 and sum(lengths) <= 64
        for v in lengths:
            used[v] += n
    assert (used == histogram).all()


def test_plan_is_tight():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6, 1, 50_000).astype(int), 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    groups = packing.plan(histogram)
    least = -(-int(lengths.sum()) // 2048)
    assert sum(n for n, _ in groups) <= 1.005 * least
    assert len(groups) < 20_000


def _pieces(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    return [ids[i : i + 2048] for i in range(0, len(ids), 2048)]


def _check_packing(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for doc, text in docs:
        for i, part in enumerate(_pieces(text, tokenizer)):
            want[(doc, i, 2048 * i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by_sequence)


def test_packing_of_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, sf_dir, "documents").collect()]
    rows = QUERIES["op6_packing"](spark, sf_dir).collect()
    sequences = _check_packing(rows, docs)
    assert sequences <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_packing_of_odd_rows(spark):
    rows = packing.pack_documents(odd(spark)).collect()
    _check_packing(rows, [(d, t) for d, t, _ in ODD])
    assert packing.pack_documents(odd(spark, [])).count() == 0


TEXTS = st.text(alphabet="aB'st re1ä́ \u0085\x1c\x0b\t\n　<|endoftext>Σ", max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_word_ids_are_text_ids(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path) if not hasattr(test_word_ids_are_text_ids, "t") else test_word_ids_are_text_ids.t
    test_word_ids_are_text_ids.t = whole
    want = whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.word_tokenizer(path).ids(text.encode()), "<u4").tolist() == want


def test_fingerprints_of_documents(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"]) for r in load(spark, sf_dir, "documents").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    _check_fingerprints(rows, docs)
    pairs = [(r["near_edited"], r["near_next"]) for r in rows.values() if r["n_chars"] > 200]
    assert np.mean([a > b for a, b in pairs]) > 0.97


def test_fingerprints_over_many_blocks(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"]) for r in load(spark, sf_dir, "documents").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in fp.edited_fingerprints(load(spark, sf_dir, "documents"), 5_000).collect()}
    _check_fingerprints(rows, docs)


def _check_fingerprints(rows, docs):
    for (doc, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        r, half = rows[doc], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.fingerprint(text) and r["edited_fingerprint"] == fp.fingerprint(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_fingerprints_of_odd_rows(spark):
    rows = fp.edited_fingerprints(odd(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    ordered = sorted(((-1 if d is None else d, t or "") for d, t, _ in ODD), key=lambda x: (-x[0], x[1]))
    want = Counter()
    for (d, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        want[(d, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest())] += 1
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["edited_sha256"]) for r in rows) == want
    assert fp.edited_fingerprints(odd(spark, [])).count() == 0
    one = fp.edited_fingerprints(odd(spark, [(1, "a b c d", "")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()


LINES = st.lists(st.text(alphabet="ab c", min_size=1, max_size=12).filter(lambda s: s.strip()), min_size=1, max_size=6)


@settings(max_examples=50, deadline=None)
@given(LINES, LINES)
def test_fingerprint_is_a_multiset_hash(first, second):
    both = fp.fingerprint("\n".join(first + second))
    assert both == fp.fingerprint("\n".join(reversed(first + second)))
    assert fp.insert(fp.fingerprint("\n".join(first)), "\n".join(second)) == both
    assert fp.delete(both, "\n".join(second)) == fp.fingerprint("\n".join(first))
    same = Counter(s.strip() for s in first) == Counter(s.strip() for s in second)
    assert (fp.fingerprint("\n".join(first)) == fp.fingerprint("\n".join(second))) == same


@pytest.mark.parametrize("runs", [40_000, 65_536])
def test_likeness_of_long_repetitive_texts(runs):
    long, longer = (fp.decode(fp.fingerprint("bad " * (n + 2)))[1] for n in (runs, runs + runs // 10))
    empty = fp.decode(fp.fingerprint(""))[1]
    assert fp.likeness(long, empty) == 0
    # One run, n and 1.1 n times: 1 - 0.01 / 2.21.
    assert abs(fp.likeness(long, longer) - (1 - 0.01 / 2.21)) < 1e-4


def test_words_are_forgotten_a_part_at_a_time(monkeypatch):
    """Texts of a block have the ids they have alone, also when few words are remembered."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 4)
    monkeypatch.setattr(packing, "BLOCK_WORDS", 3)
    path = packing.default_tokenizer()
    texts = ["One two, three.", "", "four five six seven ONE", "a\tb\n\nc two, É é <|x|>", "  eight nine ten " * 5]
    own, plain = packing.WordTokenizer(path), Tokenizer.from_file(path)
    for _ in range(2):
        found = [np.frombuffer(ids, "<u4").tolist() for ids in own.ids_of([t.encode() for t in texts])]
        assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own._young) <= 4 + len(own._old) and len(own._old) <= 40


def test_letters_are_tokenised_without_the_signs_after_them():
    """Words are remembered without punctuation, and the ids are those of the whole text."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, plain = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert list(own.ids_of([b"", b""])) == [b"", b""]
    own.ids("été. Été, été! word; WORD?".encode())
    assert set(own._young) == {w.encode() for w in "été word . , ! ; ?".split()} | {"Été".encode()}
    rng = np.random.default_rng(5)
    parts = ["a", "don't", "'S", "é", "ß", "İ", "×", "÷", "Ж", "中", "≠", "é", "̀", ".", "..", "<|", "|>", "'", "`", "_",
             "7", " ", "\n", " ", "<|endoftext|>", "ÿ", "À"]
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 30, 2000)]
    for block in (texts, [f"{t}." for t in texts[:300]], [f".{t}" for t in texts[300:600]]):
        found = [np.frombuffer(ids, "<u4").tolist() for ids in own.ids_of([t.encode() for t in block])]
        assert found == [plain.encode(t, add_special_tokens=False).ids for t in block]

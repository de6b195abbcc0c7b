"""Periodic runs: stretches of words that repeat themselves at once, and texts without the repeats.

A run of period q from word i is a maximal pair: the strings at i and i + q are equal for
some length, and neither the words before nor the words after them agree.  The pairs come
from a suffix array over words.  Its LCP intervals are visited from the leaves up; each
interval holds the positions of one repeated string, with the word to their left as
their class.  Where children of an interval meet, neighbouring positions of different
children and different classes are maximal pairs, and those whose distance satisfies the
length constraints are the runs as they stand; nothing has to be extended.  Only
neighbours need to be looked at: a position between i and i + q would give the string a
smaller period.  So classes share one list in order of position, and lists merge from
small to large.

A run of ``least_length`` words and ``least_exponent`` periods rests on a repeated string
of ``least_length * (1 - 1 / least_exponent)`` words at least.  Texts in which no string
of that length occurs twice have no runs and get no suffix array; elsewhere shorter
intervals are left out.  Each text is a matter of its own, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardlight.llm import textarrays as ta

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Words whose suffixes are sorted together.
SORT_WORDS = 1 << 17

Run = tuple[int, int, int]  # first word, words, period


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes and the common words of neighbours, by doubling.

    ``ids`` of different texts differ, so that no common string leaves its text.
    """
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while ranks[-1].max(initial=0) < n - 1:
        key = ranks[-1] * (n + 1)
        key[:-step] += ranks[-1][step:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(ranks[-1])
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        inside = np.maximum(a, b) < n
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        for v in (a, b, common):
            v[same] += 1 << level
    return order, common


def _merge(small: list[int], large: list[int], common: int, left: list[int], length: int, exponent: int, found: dict) -> list[int]:
    """Merge the position lists of two children and take up the runs between them."""
    if len(small) > len(large):
        small, large = large, small
    reach = common // (exponent - 1)  # the largest distance d with d + common >= exponent * d
    places = [bisect_left(large, p) for p in small]
    for p, k in zip(small, places):
        for j in large[max(0, k - 1) : k + 1]:
            d = p - j if p > j else j - p
            if d <= reach and d + common >= length and left[p] != left[j]:
                run = (j if p > j else p, d + common)
                if found.get(run, d) >= d:
                    found[run] = d
    if len(small) == 1:
        large.insert(places[0], small[0])
        return large
    if 8 * len(small) < len(large):
        for shift, (p, k) in enumerate(zip(small, places)):
            large.insert(k + shift, p)
        return large
    return sorted(large + small)  # two runs in order: one merge


def _runs_of_order(order: np.ndarray, common: np.ndarray, left: list[int], floor: int, length: int, exponent: int) -> dict[tuple[int, int], int]:
    """Runs as {(first word, words): smallest period}, from the intervals of ``floor`` words and more."""
    found: dict[tuple[int, int], int] = {}
    deep = common >= floor
    edges = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        positions = order[a : b + 1].tolist()
        open_: list[tuple[int, list[int]]] = []  # intervals of growing depth with what their children hold so far
        node = [positions[0]]
        for shared, p in zip(common[a:b].tolist(), positions[1:]):
            while open_ and open_[-1][0] >= shared:
                depth, held = open_.pop()
                node = _merge(node, held, depth, left, length, exponent, found)
            open_.append((shared, node))
            node = [p]
        while open_:
            depth, held = open_.pop()
            node = _merge(node, held, depth, left, length, exponent, found)
    return found


def _floor(length: int, exponent: int) -> int:
    """Least words that the string of a run's maximal pair has."""
    return length - length // exponent


def _suspects(words: np.ndarray, begins: np.ndarray, floor: int) -> np.ndarray:
    """Texts in which some string of ``floor`` words occurs twice."""
    long = np.flatnonzero(np.diff(begins) >= floor)
    if not len(long):
        return long
    hashes, at = ta.shingles(words, begins, floor)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = np.sort(ta.mix(hashes ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    twice = np.unique(own[1:][own[1:] == own[:-1]])
    if not len(twice):
        return twice.astype(np.int64)
    mixed = ta.mix(hashes ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.unique(text[twice[np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)] == mixed])


def runs_of_texts(words: np.ndarray, begins: np.ndarray, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> dict[int, list[Run]]:
    """Runs (by first word, then period) of the texts that have any; ``words`` are 64-bit hashes."""
    floor = _floor(length, exponent)
    suspects = _suspects(words, begins, floor)
    out: dict[int, list[Run]] = {}
    sizes = np.diff(begins)[suspects]
    # Groups of texts of about SORT_WORDS words; a longer text is sorted by itself.
    group = (np.cumsum(sizes) - sizes) // SORT_WORDS
    for g in np.unique(group):
        texts, size = suspects[group == g], sizes[group == g]
        text = np.repeat(np.arange(len(texts)), size)
        own = words[ta.ranges(begins[texts], size)]
        ids = ta.mix(own ^ (texts[text].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order, common = suffix_array(ids)
        # The word to the left; before a text's first word is something of its own.
        left = np.concatenate([[0], ids[:-1]])
        starts = np.cumsum(size) - size
        left[starts] = ~ids[starts]
        found = _runs_of_order(order, common, left.tolist(), floor, length, exponent)
        for (first, n), period in found.items():
            t = int(text[first])
            out.setdefault(int(texts[t]), []).append((first - int(starts[t]), n, period))
    for runs in out.values():
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def runs_by_text(texts: pa.Array, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> dict[int, list[Run]]:
    """Runs by row of a column of texts, for rows that have any."""
    out: dict[int, list[Run]] = {}
    for block in ta.blocks(texts):
        begin, end = block.word_spans()
        begins = np.searchsorted(begin, block.offsets).astype(np.int64)
        found = runs_of_texts(block.spans(begin, end), begins, length, exponent)
        out.update((block.first + t, runs) for t, runs in found.items())
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay: all but those that some run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for first, size, period in runs:
        edges[first + period] += 1
        edges[first + size] -= 1
    return np.cumsum(edges[:n]) == 0


def collapsed(text: bytes, runs: list[Run]) -> bytes:
    """The words that stay, joined by one space."""
    words = text.split()
    if runs:
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return b" ".join(words)


_RUNS = "doc_id long, text string, runs array<struct<start: long, length: long, period: long>>"


def periodic_runs(documents: DataFrame, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``doc_id, text, runs`` for every row: the runs by first word, then period.

    Words are the stretches without ASCII white space, numbered from 0.  Null and empty
    texts have no words and no runs; ``text`` stays as it is.  Rows are treated one by
    one, repeated ids and rows too; other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = runs_by_text(batch.column("text"), length, exponent)
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found.get(i, ())] for i in range(batch.num_rows)]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(rows, kind)], ["doc_id", "text", "runs"])

    return _texts(documents).mapInArrow(ta.tidy(find), _RUNS)


def without_periodic_runs(documents: DataFrame, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``documents`` with each run cut to its first period.

    All columns stay, whatever their names.  Texts without runs, null ones too, are
    unchanged; in the others, words are joined by one space.
    """

    def cut(texts: pd.Series) -> pd.Series:
        found = runs_by_text(pa.array(texts, pa.string()), length, exponent)
        return pd.Series([collapsed(t.encode(), found[i]).decode() if i in found else t for i, t in enumerate(texts)], dtype=object)

    return documents.withColumn("text", F.pandas_udf(cut, "string")(F.col("text").cast("string")))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_planted_runs(doc_id: int | None, text: bytes) -> bytes:
    """The text of one id in ten with its words repeated from a place on; others, and null ids, unchanged."""
    if doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return text
    words, g = text.split(), h // 10
    n = len(words)
    if not n:
        return text
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % period] for i in range(n - a)])


def longest(runs: list[Run]) -> Run | None:
    """The run of the greatest length in periods; ties go to the first word, then the period."""
    best = None
    for run in runs:
        # Runs come by first word and period, so that equal ones do not replace the best.
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_DIGESTS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def run_digests(documents: DataFrame) -> DataFrame:
    """Runs of every text after :func:`with_planted_runs`, as digests.

    ``doc_id, n_runs``; ``start, length, period, exponent_milli`` of the :func:`longest`
    run, null without one; ``runs_sha256`` of all runs as lines, and ``collapsed_sha256``
    of the words that stay.  Nulls, empty texts and repeated rows as in
    :func:`periodic_runs`; an empty table gives no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.large_binary())
            planted = [with_planted_runs(i, t.as_py() or b"") for i, t in zip(ids, texts)]
            found = runs_by_text(pa.array(planted, pa.large_binary()))
            rows = []
            for i, (doc, text) in enumerate(zip(ids, planted)):
                runs = found.get(i, [])
                best = longest(runs)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rows.append((
                    doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(text, runs)).hexdigest(),
                ))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _DIGESTS.split(", ")])

    return _texts(documents).mapInArrow(ta.tidy(digest), _DIGESTS)

"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity to the whole
document, so MinHash needs sets of bounded size.  Items fall into partitions by the
number of their n-grams; for the partition with sizes up to ``u``, every document is seen
as windows of two neighbouring runs of ``u`` n-grams.  An item of the partition lies
within one window and makes up at least a known share of it, which fixes how many hashes
find it.  A window is a candidate if any of its minima is the item's; candidates are
verified by counting the item's n-grams in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wardlight.llm import textarrays as ta
from wardlight.llm.tables import without_ids
from wardlight.workspace import Workspace

WORDS = 5
PERCENT = 75
#: Single-hash bands.  An item at the threshold in the worst window is missed with (1 - 0.17) ** HASHES.
HASHES = 48
#: Smallest partition; each further one is twice as large.
LEAST = 1
#: N-grams of items, of 24 bytes each, whose bytes are sent to the tasks at once; more take further passes.
ITEM_GRAMS = 1_000_000
#: Bytes of an item besides its n-grams: 48 minima with their item numbers, the id and the array around the set.
ITEM_BYTES = 16 * HASHES + 160

_FACTORS = np.random.default_rng(99).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCHEMA = "doc_id long, item_id long, n_shingles long, n_found long"


class Items:
    """Signatures of some items, by partition."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.grams = pa.array(np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)])))
        self.partitions: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size_of = [max(LEAST, 1 << (len(s) - 1).bit_length()) for s in sets]
        for size in sorted(set(size_of)):
            own = np.array([i for i, s in enumerate(size_of) if s == size])
            tables = []
            for factor in _FACTORS:
                least = np.array([(sets[i] * factor).min() for i in own], np.uint64)
                order = np.argsort(least, kind="stable")
                tables.append((least[order], own[order]))
            self.partitions[size] = tables

    def sharing(self, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The texts that share any n-gram with an item; equal minima are equal n-grams."""
        known = pc.is_in(pa.array(hashes), value_set=self.grams).to_numpy(zero_copy_only=False)
        shared = np.append(0, np.cumsum(known))
        return np.flatnonzero(shared[begins[1:]] > shared[begins[:-1]])

    def candidates(self, hashes: np.ndarray, begins: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a minimum in some window."""
        found: set[tuple[int, int]] = set()
        # Most texts share nothing, and need no signatures.
        texts = self.sharing(hashes, begins)
        if not len(texts):
            return found
        counts = np.diff(begins)[texts]
        hashes = hashes[ta.ranges(begins[texts], counts)]
        begins = np.append(0, np.cumsum(counts))
        layouts = {}
        for size in self.partitions:
            runs = -(-counts // size)
            starts = np.repeat(begins[:-1], runs) + size * ta.ranges(np.zeros(len(runs), np.int64), runs)
            text = np.repeat(texts, runs)
            pairs = np.flatnonzero(text[1:] == text[:-1])
            alone = np.flatnonzero(np.repeat(runs == 1, runs))
            layouts[size] = starts, text, pairs, alone
        for k, factor in enumerate(_FACTORS):
            values = hashes * factor
            for size, tables in self.partitions.items():
                starts, text, pairs, alone = layouts[size]
                least = np.minimum.reduceat(values, starts)
                for windows, owner in (
                    (np.minimum(least[pairs], least[pairs + 1]), text[pairs]), (least[alone], text[alone])
                ):
                    wanted, item = tables[k]
                    low = np.searchsorted(wanted, windows, "left")
                    hit = np.flatnonzero(wanted[np.minimum(low, len(wanted) - 1)] == windows)
                    for w in hit:
                        at = low[w]
                        while at < len(wanted) and wanted[at] == windows[w]:
                            found.add((int(owner[w]), int(item[at])))
                            at += 1
        return found


def _item_sets(items: list[tuple[int, str | None]], words: int) -> tuple[list[int], list[np.ndarray]]:
    ids, sets = [], []
    for block in ta.blocks(pa.array([t for _, t in items], pa.string())):
        hashes, begins = ta.distinct(*ta.shingles(*block.words(), words))
        for i, a, b in zip(range(block.first, block.last), begins[:-1], begins[1:]):
            if b > a:
                ids.append(items[i][0])
                sets.append(hashes[a:b])
    return ids, sets


def _slices(benchmark: DataFrame, words: int) -> Iterator[Items]:
    """The items in slices of bounded size; those without words cannot be found."""
    waiting, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.filter("item_id is not null and text is not null").distinct().toLocalIterator():
        waiting.append((row["item_id"], row["text"]))
        # A word has a sign and a space at least; its text waits, and its n-gram has 8 bytes.
        size += ITEM_BYTES + 5 * len(row["text"])
        if size > 24 * ITEM_GRAMS:
            yield Items(*_item_sets(waiting, words))
            waiting, size = [], 0
    if waiting:
        yield Items(*_item_sets(waiting, words))


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment``: items found in documents.

    An item is found if the document holds at least ``percent`` / 100 of the item's
    ``n_shingles`` distinct ``words``-grams; the counts are exact.  Words are split at
    ASCII white space, A-Z lowered; a text of fewer words is one n-gram, one without
    words (or null) has none.  Repeated document rows give repeated results, repeated
    benchmark rows count once, rows without an id are skipped.  Empty tables give no
    rows.  Items are read to the driver in slices of about 24 MB, signatures
    included, with one pass each; the pairs of a pass are written before the next slice
    but one is read, so that the driver holds two slices at most.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        "doc_id is not null"
    )
    ws, found, waiting = workspace, None, None

    def one_pass(items: Items) -> DataFrame:
        return texts.mapInArrow(ta.tidy(_searcher(items, words, percent)), _SCHEMA)

    for items in _slices(benchmark, words):
        if not items.ids:
            continue
        if waiting is not None:
            ws = ws or Workspace(documents.sparkSession)
            written = ws.write(one_pass(waiting), "found")
            found = written if found is None else found.union(written)
        waiting = items
    if waiting is not None:
        last = one_pass(waiting)
        found = last if found is None else found.union(last)
    elif found is None:
        found = documents.sparkSession.createDataFrame([], _SCHEMA)
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def _searcher(items: Items, words: int, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for block in ta.blocks(batch.column("text")):
                hashes, begins = ta.shingles(*block.words(), words)
                rows, own, text_of = [], None, -1
                for text, item in sorted(items.candidates(hashes, begins)):
                    if text != text_of:
                        own, text_of = np.sort(hashes[begins[text] : begins[text + 1]]), text
                    wanted = items.sets[item]
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    n = int((own[at] == wanted).sum())
                    if 100 * n >= percent * len(wanted):
                        rows.append((int(ids[block.first + text]), items.ids[item], len(wanted), n))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "n_shingles", "n_found"]
                    )

    return search


def without_contaminated(documents: DataFrame, benchmark: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """``documents`` without those that hold an item; rows without an id stay."""
    ws = workspace or Workspace(documents.sparkSession)
    return without_ids(documents, contaminated(documents, benchmark, workspace=ws), ws)

"""Order-independent document fingerprints: a multiset hash of paragraphs.

Every paragraph gives a wide vector that depends on nothing else; a document's
fingerprint is the sum of its paragraphs' vectors, lane by lane modulo a power of two.
Sums commute, so paragraph order does not matter, and a paragraph is inserted or deleted
by adding or subtracting its vector.

A vector has two parts.  ``DENSE`` lanes modulo 2**32 come from a cryptographic hash of
the paragraph and decide equality.  ``SKETCH`` lanes modulo 2**32, read back signed, take +1 or -1
for every run of three words of the paragraph, and no text has 2**31 runs; the squared length of a difference then estimates
how many runs two documents do not share, which gives a likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardlight.llm import textarrays as ta
from wardlight.llm.tables import TASK_BYTES, parts_for, text_bytes

DENSE = 32
SKETCH = 128
RUN_WORDS = 3


def paragraphs(text: str) -> list[str]:
    """The lines of a text without outer white space; blank lines do not count."""
    return [p for line in text.split("\n") if (p := line.strip())]


def sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The dense and sketch lanes of each text."""
    dense = np.zeros((len(texts), DENSE), np.uint32)
    sketch = np.zeros((len(texts), SKETCH), np.int64)
    parts = [paragraphs(t) for t in texts]
    for i, own in enumerate(parts):
        if own:
            raw = b"".join([hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(4 * DENSE) for p in own])
            dense[i] = np.frombuffer(raw, "<u4").reshape(-1, DENSE).sum(0, dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    column = pa.array([p.encode("utf-8", "surrogatepass") for own in parts for p in own], pa.large_binary())
    for block in ta.blocks(column):
        hashes, begins = ta.shingles(*block.words(), RUN_WORDS)
        row = np.repeat(owner[block.first : block.last], np.diff(begins))
        lane = (hashes >> np.uint64(1)) % np.uint64(SKETCH)
        sign = (hashes & np.uint64(1)).astype(np.int64) * 2 - 1
        if len(row):
            low, high = int(row[0]), int(row[-1]) + 1
            cell = (row - low) * SKETCH + lane.astype(np.int64)
            sketch[low:high] += np.bincount(cell, sign, (high - low) * SKETCH).reshape(-1, SKETCH).astype(np.int64)
    return dense, (sketch & 0xFFFFFFFF).astype(np.uint32)


def encode(dense: np.ndarray, sketch: np.ndarray) -> str:
    return dense.astype("<u4").tobytes().hex() + sketch.astype("<u4").tobytes().hex()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw, "<u4", DENSE), np.frombuffer(raw, "<u4", SKETCH, 4 * DENSE)


def fingerprint(text: str) -> str:
    dense, sketch = sums([text])
    return encode(dense[0], sketch[0])


def insert(fingerprint_: str, text: str) -> str:
    """The fingerprint after the paragraphs of ``text`` were added anywhere."""
    (d, s), (dense, sketch) = decode(fingerprint_), sums([text])
    return encode(d + dense[0], s + sketch[0])


def delete(fingerprint_: str, text: str) -> str:
    """The fingerprint after the paragraphs of ``text`` were taken out."""
    (d, s), (dense, sketch) = decode(fingerprint_), sums([text])
    return encode(d - dense[0], s - sketch[0])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of word runs in common, from sketch lanes; 1 for equal sketches."""
    x, y = a.astype(np.uint32).view(np.int32).astype(float), b.astype(np.uint32).view(np.int32).astype(float)
    apart = (a - b).astype(np.uint32).view(np.int32).astype(float)
    size = (x * x).sum(-1) + (y * y).sum(-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        like = np.where(size > 0, 1 - (apart * apart).sum(-1) / size, 1.0)
    return np.clip(like, 0, 1)


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)
#: Texts that are fingerprinted together.
GROUP_CHARS = 1 << 21


def edited_fingerprints(documents: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Fingerprint each document, and its text with the last half taken from the next one.

    The next document is the one with the next smaller ``doc_id``; after the last comes
    the first.  Null ids come last; repeated rows, and different texts of one id, follow
    one another in the order of their texts and are documents of their own.  Null texts
    are empty.  A single document is its own next.  An empty table gives no rows.

    Documents are dealt into blocks of neighbouring ids of about ``task_bytes`` of text,
    and the first document of a block is copied to the block before it; so the whole
    texts move once.
    """
    spark = documents.sparkSession
    lowest = F.lit(-(2**63)).cast("long")
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("_key", F.coalesce("doc_id", lowest))
    parts = parts_for(text_bytes(docs), task_bytes)
    # One id per block: about one number per `task_bytes` of text.
    bounds = docs.agg(
        F.max("_key").alias("top"),
        F.percentile_approx("_key", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 100 * parts).alias("cuts"),
    ).first()
    if bounds["top"] is None:
        return spark.createDataFrame([], _SCHEMA)
    firsts = np.array(sorted({bounds["top"], *bounds["cuts"]}, reverse=True), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            # The block of a key is the last one whose first key is not below it.
            block = len(firsts) - np.searchsorted(firsts[::-1], keys, "left") - 1
            yield _with_block(batch, block, np.zeros(len(keys), bool))
            heads = np.flatnonzero(firsts[block] == keys)
            if len(heads):
                # The first text of a block in order of texts is chosen after the shuffle.
                yield _with_block(batch.take(pa.array(heads)), (block[heads] - 1) % len(firsts), np.ones(len(heads), bool))

    dealt = docs.mapInArrow(deal, "doc_id long, text string, _key long, block int, extra boolean")
    ordered = dealt.repartition(parts, "block").sortWithinPartitions("block", "extra", F.desc("_key"), "text")
    return ordered.mapInArrow(_compare, _SCHEMA)


def _with_block(batch: pa.RecordBatch, block: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
    names = ["doc_id", "text", "_key"]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in names] + [pa.array(block, pa.int32()), pa.array(extra)], names + ["block", "extra"]
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each row with the one after it; the block's copied row has no result of its own."""
    held: list[tuple[int | None, str]] = []
    size, at = 0, None
    ended = False

    def results(last: bool):
        nonlocal held, size
        done = _results(held)
        held, size = ([] if last else held[-1:]), 0
        return done

    for batch in batches:
        for doc, text, block, extra in zip(*(batch.column(n) for n in ("doc_id", "text", "block", "extra"))):
            block, text = block.as_py(), text.as_py()
            if block != at:
                at, ended = block, False
                held, size = [], 0
            if ended:
                continue
            held.append((doc.as_py(), text))
            size += len(text)
            ended = extra.as_py()
            if ended or size > GROUP_CHARS:
                if len(held) > 1:
                    yield results(ended)


def _results(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    edited = []
    for own, following in zip(texts, texts[1:]):
        half = len(own) // 2
        edited.append(own[: len(own) - half] + following[:half])
    dense, sketch = sums(texts)
    dense_2, sketch_2 = sums(edited)
    n = len(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows[:n]], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array([encode(dense[i], sketch[i]) for i in range(n)]),
            pa.array([encode(dense_2[i], sketch_2[i]) for i in range(n)]),
            pa.array(likeness(sketch[:n], sketch_2)),
            pa.array(likeness(sketch[:n], sketch[1:])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )

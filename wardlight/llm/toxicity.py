"""Toxicity by subword-bag embeddings: averaged n-gram vectors under a linear softmax.

A word's vector is the mean of the vectors of itself and its character n-grams, hashed
into ``BUCKETS`` rows; a text's vector is the mean over its words.  Embeddings and
softmax weights are trained together, in numpy, on a bounded sample of labelled texts.
As everything behind the embeddings is linear, scoring needs one number per bucket.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wardlight.llm import textarrays as ta
from wardlight.llm.tables import free_names

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
WIDTH = 8
SCALE = 8
#: Words of a zero vector that every text's mean includes, so that short texts need stronger signs.
BLANK_WORDS = 100
#: Labelled documents that a model is fitted on, at most: of class 0 and of class 1.
SAMPLE = (7_500, 2_500)
#: Steps of 256 texts.
STEPS = 320
RATE = 0.1
START = 0.01
FLOOR = 20.0
#: Shrinking of all weights in each step, against rare n-grams that fit by chance.
DECAY = 0.03
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_APART = np.array([not _WORD.match(bytes([c])) for c in range(256)])


def words(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII bytes, with A-Z lowered."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def grams(words_: ta.Block) -> tuple[np.ndarray, np.ndarray]:
    """For a block with one word per text: rows of the table, and the word that each belongs to.

    A word has a row for itself, with marks at both ends, and for each run of 3 to 5 bytes.
    """
    sizes = np.diff(words_.offsets)
    to = words_.offsets[:-1] + 2 * np.arange(len(sizes))
    data = np.full(len(words_.data) + 2 * len(sizes), ord("<"), np.uint8)
    data[to + sizes + 1] = ord(">")
    marks = np.zeros(len(data), bool)
    marks[to] = marks[to + sizes + 1] = True
    data[~marks] = ta.lowered(words_.data)
    marked = ta.Block(0, data, np.append(to, len(data)))
    # Of each byte: its word, and where that ends.
    word = np.repeat(np.arange(len(sizes)), sizes + 2)
    limit = (to + sizes + 2)[word]
    hashes, owners = [marked.spans(to, to + sizes + 2)], [np.arange(len(sizes))]
    for n in GRAMS:
        inside = np.flatnonzero(np.arange(n, len(data) + 1) <= limit[: max(0, len(data) - n + 1)])
        hashes.append(marked.runs(n)[inside])
        owners.append(word[inside])
    # A power of two: the lowest bits are the remainder.
    return (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(owners)


@dataclass
class Model:
    """The logit of a text is ``bias`` plus the mean of its words' scores."""

    bucket_scores: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Chance of class 1 for each text; null and empty ones have no words."""
        out = np.empty(len(texts))
        for block in ta.blocks(texts):
            begin, end = block.word_spans(_APART)
            number = np.searchsorted(begin, block.offsets)
            # Words are numbered as they appear.
            word = pa.array(block.spans(begin, end, lower=True)).dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(np.maximum.accumulate(word), prepend=-1))
            sizes = (end - begin)[first]
            own = ta.Block(0, block.data[ta.ranges(begin[first], sizes)], np.append(0, np.cumsum(sizes)))
            rows, owner = grams(own)
            word_scores = np.bincount(owner, self.bucket_scores[rows], len(first)) / np.bincount(owner, minlength=len(first))
            total = np.append(0, np.cumsum(word_scores[word]))
            n = np.diff(number)
            z = self.bias + (total[number[1:]] - total[number[:-1]]) / (n + BLANK_WORDS)
            out[block.first : block.last] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return out


class Sample:
    """Word counts of labelled texts, as numbers into a common vocabulary."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.labels: list[int] = []

    def add(self, words_: list[bytes], counts: list[int] | np.ndarray, label: int) -> None:
        if words_:
            number = self.vocabulary.setdefault
            self.words.append(np.array([number(w, len(self.vocabulary)) for w in words_], np.int32))
            self.counts.append(np.array(counts, np.float32))
            self.labels.append(label)


def _means(table: np.ndarray, rows: np.ndarray, share: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Weighted sums of table rows over groups that follow one another."""
    vectors = table.take(rows, axis=0)
    vectors *= share[:, None]
    return np.add.reduceat(vectors, begins, axis=0)


def _spread(gradient: np.ndarray, group: np.ndarray, rows: np.ndarray, share: np.ndarray, height: int) -> np.ndarray:
    """The gradient of :func:`_means` for its table."""
    columns = [np.bincount(rows, g[group] * share, height) for g in gradient.T]
    return np.stack(columns, axis=1).astype(np.float32)


def train(sample: Sample, positive_share: float, seed: int = 1) -> Model:
    """Fit embeddings and softmax on word counts per text by Adam over mini-batches.

    A fifth of the texts is set aside; ``positive_share``, the share of positives to
    expect, and those texts set the bias with the fewest expected errors.
    """
    labels = np.array(sample.labels, int)
    if len(set(labels.tolist())) < 2:
        share = min(max(positive_share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), math.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    aside, order = order[: len(order) // 5], order[len(order) // 5 :]
    table = rng.normal(0, START, (BUCKETS, WIDTH)).astype(np.float32)
    softmax = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("table", table), ("softmax", softmax))}
    weight = (len(labels) / 2 / np.bincount(labels, minlength=2))[labels].astype(np.float32)
    all_grams, sizes = [], []
    for block in ta.blocks(pa.array(list(sample.vocabulary), pa.large_binary()), 1 << 17):
        rows, owner = grams(block)
        all_grams.append(rows[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner).astype(np.int32))
    all_grams, sizes = np.concatenate(all_grams), np.concatenate(sizes)
    gram_begins = np.append(0, np.cumsum(sizes))
    batches = [order[i : i + 256] for i in range(0, len(order), 256)]
    epochs = -(-STEPS // len(batches))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            chosen = batches[k]
            lengths = np.array([len(sample.words[i]) for i in chosen])
            text = np.repeat(np.arange(len(chosen)), lengths)
            counts = np.concatenate([sample.counts[i] for i in chosen])
            share = (counts / (np.bincount(text, counts) + BLANK_WORDS)[text]).astype(np.float32)
            used, word = np.unique(np.concatenate([sample.words[i] for i in chosen]), return_inverse=True)
            rows = all_grams[ta.ranges(gram_begins[used], sizes[used])]
            of_word = np.repeat(np.arange(len(used)), sizes[used])
            part = (1 / sizes[used]).astype(np.float32)[of_word]
            word_vectors = _means(table, rows, part, np.cumsum(sizes[used]) - sizes[used])
            vectors = _means(word_vectors, word, share, np.cumsum(lengths) - lengths)
            logits = vectors @ softmax * SCALE
            logits -= logits.max(1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(chosen)), labels[chosen]] -= 1
            miss = (chance * weight[chosen, None] * (SCALE / len(chosen))).astype(np.float32)
            to_words = _spread(miss @ softmax.T, text, word, share, len(used))
            gradients = {"softmax": vectors.T @ miss, "table": _spread(to_words, of_word, rows, part, BUCKETS)}
            for name, value in (("softmax", softmax), ("table", table)):
                first, second = state[name]
                g = gradients[name]
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                # The floor keeps steps of rare n-grams small, which else fit single texts.
                floor = FLOOR * np.sqrt(second.mean()) if name == "table" else 0
                value -= rate * first / (np.sqrt(second) + floor + 1e-8)
                if name == "table":
                    value *= 1 - DECAY * rate
    scores = (table @ (softmax[:, 1] - softmax[:, 0]) * SCALE).astype(np.float32)
    word_scores = np.add.reduceat(scores[all_grams], gram_begins[:-1]) / sizes
    aside = aside if len(set(labels[aside].tolist())) == 2 else order
    logit = np.array([
        word_scores[sample.words[i]] @ sample.counts[i] / (sample.counts[i].sum() + BLANK_WORDS) for i in aside
    ])
    return Model(scores, _bias(logit, labels[aside], positive_share))


def _bias(logit: np.ndarray, labels: np.ndarray, positive_share: float) -> float:
    """Minus the cut with the fewest expected errors; the middle of the best gap."""
    order = np.argsort(logit)
    z, y = logit[order], labels[order]
    cost = np.where(y == 1, positive_share / max(1, (y == 1).sum()), (1 - positive_share) / max(1, (y == 0).sum()))
    errors = np.concatenate([[0], np.cumsum(np.where(y == 1, cost, -cost))]) + cost[y == 0].sum()
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    low, high = edges[best[0]], edges[best[-1] + 1]
    return -float(low + high) / 2


def held_out(doc_id: Column) -> Column:
    """True where labels must not be learned: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE) -> Model:
    """Fit on at most ``most[c]`` labelled documents of class c that are not held out.

    The sample is the documents with the smallest hashes of their ids, so it does not
    depend on the order of rows; of several texts of one id the smallest counts.  Rows
    without an id or label, and ids labelled both ways, are not learned from.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("toxic in (0, 1) and doc_id is not null")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_other"))
        .filter("toxic = _other").drop("_other")
    )
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = [
        usable.filter(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[side]) for side in (0, 1)
    ]
    # At most sum(most) rows of two numbers.
    picked = F.broadcast(chosen[0].union(chosen[1]))
    bags = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(picked, "doc_id")
        .groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
        .mapInArrow(ta.tidy(_count_words), "doc_id long, toxic int, words array<binary>, counts array<int>")
    )
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5

    def train_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sample()
        for batch in batches:
            for own, counted, label in zip(*(batch.column(c) for c in ("words", "counts", "toxic"))):
                sample.add(own.as_py(), counted.values.to_numpy(), label.as_py())
        model = train(sample, share)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.bucket_scores.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], ["scores", "bias"]
        )

    # The words are counted in many tasks; one fits the bounded sample, which keeps the driver small.
    model = bags.repartition(1).sortWithinPartitions("doc_id").mapInArrow(ta.tidy(train_on), "scores binary, bias double").first()
    if model is None:
        return train(Sample(), share)
    return Model(np.frombuffer(bytes(model["scores"]), "<f4"), model["bias"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [Counter(words(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("toxic"),
                pa.array([list(b) for b in bags], pa.list_(pa.binary())),
                pa.array([list(b.values()) for b in bags], pa.list_(pa.int32())),
            ],
            ["doc_id", "toxic", "words", "counts"],
        )


def add_scores(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add the chance that a text is toxic (a column of this name is replaced)."""
    documents = documents.drop(name)
    at = documents.columns.index("text")
    # Python functions take no column whose name holds a dot.
    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("score", pa.array(model.scores(batch.column(at))))

    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(ta.tidy(score), schema).toDF(*documents.columns, name)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    Repeated rows are scored alike; null texts count as empty.  An empty table gives no
    rows.  Without labels of both classes every text gets the expected share.
    """
    scored = add_scores(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(documents, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those scored at 0.5 or more; all columns stay, whatever their names."""
    (score,) = free_names(documents, "toxic_score")
    return add_scores(documents, fit(documents, labels), score).filter(F.col(score) < 0.5).drop(score)

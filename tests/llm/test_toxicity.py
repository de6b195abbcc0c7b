"""The toxicity model by its accuracy on documents it was not fitted on."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from wardlight.llm import textarrays as ta, toxicity as tx
from wardlight.llm.registry import QUERIES
from wardlight.llm.tables import load


def _auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = load(spark, sf_dir, "documents").count()
    rows = QUERIES["op8_toxicity"](spark, sf_dir)
    assert rows.count() == docs
    seen = rows.join(load(spark, sf_dir, "labels"), "doc_id").toPandas()
    for r in seen.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = seen[seen.held_out]
    assert _auc(test.score.to_numpy(), test.toxic.to_numpy()) > 0.9


def test_unseen_misspellings():
    rng = np.random.default_rng(1)
    plain = ["river", "house", "green", "walked", "yellow", "window", "table", "slowly", "letter", "garden"]
    sample = tx.Sample()
    for i in range(200):
        bag = {w: 1 for w in rng.choice(plain, 6, replace=False)}
        if i % 2:
            bag["worthless"] = 2
        sample.add([w.encode() for w in bag], list(bag.values()), i % 2)
    model = tx.train(sample, 0.5)
    texts = ["green house by river", "w0rthless house worthlesss worthles by river", "WORTHLESS!", "", None]
    scores = model.scores(pa.array(texts))
    assert scores[0] < 0.5 < scores[1] < 1 and scores[2] > 0.5 and scores[3] == scores[4]
    assert np.allclose(scores[:3], np.concatenate([model.scores(pa.array([t])) for t in texts[:3]]))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 1), (2, "", 1), (None, "x", 2), (3, "bad " * 50_000, 3)], "doc_id long, text string, score int"
    )
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (7, 0)], "doc_id long, toxic int")
    rows = tx.score_documents(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert tx.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_learns_nothing_from_held_out_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"word{i} text") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert not tx.fit(docs, labels).bucket_scores.any()


def test_scores_equal_a_plain_version():
    """A text's score from the means over its words' own and n-gram rows, one by one."""
    rng = np.random.default_rng(2)
    model = tx.Model(rng.normal(0, 3, tx.BUCKETS).astype(np.float32), -0.25)

    def row(piece: bytes) -> int:
        block = ta.Block(0, np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))
        return int(block.spans(np.array([0]), np.array([len(piece)]))[0] % np.uint64(tx.BUCKETS))

    def plain(text: str | None) -> float:
        found, total = tx.words(text or ""), 0.0
        for word in found:
            marked = b"<" + word + b">"
            pieces = [marked, *(marked[i : i + n] for n in tx.GRAMS for i in range(len(marked) - n + 1))]
            total += np.mean([model.bucket_scores[row(p)] for p in pieces])
        return 1 / (1 + np.exp(-(model.bias + total / (len(found) + tx.BLANK_WORDS))))

    texts = [None, "", "a", "Some WORDS, some words again; größe 日本", "x" * 300, "...", "one two " * 50]
    assert np.allclose(model.scores(pa.array(texts, pa.string())), [plain(t) for t in texts], atol=1e-6)


def test_several_texts_of_one_id(spark):
    """The smallest text of an id is learned from, whatever the order and partitions of rows."""
    rows = [(i, f"bad{i % 7} stuff {i}" if i % 2 else f"good{i % 5} things {i}") for i in range(300)]
    rows += [(i, "zzz other text") for i in range(0, 300, 3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = (tx.fit(d, labels) for d in (docs, docs.orderBy("text").repartition(5)))
    assert one.bias == other.bias and np.array_equal(one.bucket_scores, other.bucket_scores)

"""Importance resampling towards a target: documents drawn by how much they look like it.

Hashed one- and two-word features are counted over the corpus and the target.  Each
bucket's gain is the logarithm of the ratio of its smoothed shares; numpy scores whole
blocks of text with the table of gains, and Gumbel noise of the id turns the best scores
into a draw without replacement.

The ranks come from a distributed radix sort.  A composite key (score downwards, id,
number of features) is cut into digits; for each digit, least significant first, every
block counts its digits, prefix sums over (digit, block) give each record its place, and
the records move to the block of their place.  Such a pass is stable, so the last one
leaves the whole order.  Blocks hold the same number of records however the keys are spread.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wardlight.llm import textarrays as ta
from wardlight.workspace import Workspace

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Records of a block of the sort, and bits of a digit.
BLOCK_ROWS = 1 << 16
DIGIT_BITS = 11
#: Bytes of places that may be broadcast to the blocks.
BROADCAST_BYTES = 32 << 20

_SPACE = 0x20
#: Bytes that end a word; A-Z are lowered, so they belong to words.
_APART = np.ones(256, bool)
_APART[0x30:0x3A] = _APART[0x41:0x5B] = _APART[0x61:0x7B] = _APART[0x80:] = False
#: Longer words are hashed one by one.
_LONG = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _crc_after(crc: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``crc`` was taken of, followed by ``size[i]`` bytes at ``begin[i]``."""
    order = np.argsort(-size, kind="stable")
    begin, size, state = begin[order], size[order], ~crc[order]
    long = int(np.searchsorted(-size, -_LONG, "left"))
    for i in range(long):
        state[i] = ~np.uint32(zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes(), int(~state[i])))
    for j in range(int(size[long]) if long < len(size) else 0):
        active = slice(long, int(np.searchsorted(-size, -j, "left")))
        state[active] = _CRC[(state[active] ^ data[begin[active] + j]) & np.uint32(255)] ^ (state[active] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _features(block: ta.Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of single words and of word pairs, and where each text's words and pairs begin."""
    begin, end = block.word_spans(_APART)
    data, size = ta.lowered(block.data), end - begin
    first = np.searchsorted(begin, block.offsets).astype(np.int64)
    one = _crc_after(np.zeros(len(begin), np.uint32), data, begin, size)
    # The last word of a text starts no pair.
    starts = np.ones(len(begin), bool)
    starts[first[1:][np.diff(first) > 0] - 1] = False
    head = np.flatnonzero(starts)
    state = ~one[head]
    spaced = ~(_CRC[(state ^ np.uint32(_SPACE)) & np.uint32(255)] ^ (state >> np.uint32(8)))
    two = _crc_after(spaced, data, begin[head + 1], size[head + 1])
    pairs = np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(first) - 1))]).astype(np.int64)
    return one % np.uint32(buckets), two % np.uint32(buckets), first, pairs


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; ``buckets`` numbers come to the driver, whatever the table's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in ta.blocks(batch.column(0)):
                one, two, *_ = _features(block, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(ta.tidy(count), "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the corpus."""
    n, corpus_all, target_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (corpus_all + n) / ((s + 1) * (target_all + n))))
        for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())
    ], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id alone; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, print long, n_words long, n_features long, weight long, score long"


def scored(documents: DataFrame, table: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, print, n_words, n_features, weight, score`` of every row; ``print`` is a hash of the text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for block in ta.blocks(batch.column("text")):
                one, two, first, pairs = _features(block, len(table))
                sums = [np.concatenate([[0], np.cumsum(table[v])]) for v in (one, two)]
                total = np.diff(sums[0][first]) + np.diff(sums[1][pairs])
                n = np.diff(first) + np.diff(pairs)
                words.append(np.diff(first))
                features.append(n)
                weights.append(total // np.maximum(n, 1))
            n, f, w = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (words, features, weights))
            drawn = np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), *map(pa.array, (n, f, w, w + drawn))],
                ["doc_id", "print", "n_words", "n_features", "weight", "score"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(ta.tidy(score), _SCORED)


# A record of the sort: id (0 if null), whether it is null, print, features, weight, score.
_FIELDS = 6
_BLOCK = "block long, records binary, counts array<long>"


class _Key:
    """Bits of the composite key of records, the lowest first: features, id, null id, score downwards."""

    def __init__(self, low: dict[str, int], high: dict[str, int]):
        self.low, self.high = low, high
        self.bits = [(high[c] - low[c]).bit_length() for c in ("n_features", "doc_id")] + [1] + [(high["score"] - low["score"]).bit_length()]

    def digits(self, records: np.ndarray, at: int, width: int) -> np.ndarray:
        """Bits ``at`` to ``at + width`` of each record's key."""
        doc, null, _, features, _, score = records.view(np.uint64)
        u = lambda n: np.uint64(n % 2**64)
        parts = (features - u(self.low["n_features"]), np.where(null > 0, u(0), doc - u(self.low["doc_id"])), null, u(self.high["score"]) - score)
        out, base = np.zeros(len(doc), np.int64), 0
        for part, bits in zip(parts, self.bits):
            low, high = max(at, base), min(at + width, base + bits)
            if low < high:
                piece = (part >> np.uint64(low - base)) & np.uint64((1 << (high - low)) - 1)
                out |= (piece << np.uint64(low - at)).astype(np.int64)
            base += bits
        return out


def _records(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(_FIELDS, -1)


def _block_row(number: int, records: np.ndarray, key: _Key, at: int, width: int) -> tuple:
    return number, records.tobytes(), np.bincount(key.digits(records, at, width), minlength=1 << width).tolist()


def _to_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def _first_blocks(rows: DataFrame, key: _Key, width: int, block_rows: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def blocks(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            whole = np.concatenate(held, axis=1)
            cut = size if all_of_it else size - size % block_rows
            for a in range(0, cut, block_rows):
                row = _block_row(number, np.ascontiguousarray(whole[:, a : min(a + block_rows, cut)]), key, 0, width)
                yield _to_batch([row], [pa.int64(), pa.binary(), pa.list_(pa.int64())], ["block", "records", "counts"])
                number += 1
            held, size = [whole[:, cut:]], size - cut

        for batch in batches:
            doc = batch.column("doc_id")
            held.append(np.stack([
                doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                *(batch.column(c).to_numpy() for c in ("print", "n_features", "weight", "score")),
            ]))
            size += batch.num_rows
            if size >= block_rows:
                yield from blocks(False)
        if size:
            yield from blocks(True)

    return rows.mapInArrow(pack, _BLOCK)


def _places(blocks: DataFrame, width: int) -> DataFrame:
    """``block, places``: for each digit of each block, where its first record goes."""
    counts = blocks.select("block", F.posexplode("counts").alias("digit", "n")).filter("n > 0")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most 2 ** width rows meet in one task here, and one row per block below.
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    starts = totals.select("digit", before(Window.orderBy("digit")).alias("start"))
    inside = counts.select("block", "digit", before(Window.partitionBy("digit").orderBy("block")).alias("before"))
    return (
        inside.join(F.broadcast(starts), "digit")
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("digit", (F.col("start") + F.col("before")).alias("to")))).alias("places"))
    )


def _pass(blocks: DataFrame, ws: Workspace, key: _Key, at: int, width: int, block_rows: int, broadcast_bytes: int) -> DataFrame:
    """One stable counting sort by the digit at bit ``at``; the new blocks count the next digit."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places in zip(batch.column("records"), batch.column("places").to_pylist()):
                records = _records(data.as_py())
                digit = key.digits(records, at, width)
                order = np.argsort(digit, kind="stable")
                first = np.zeros(1 << width, np.int64)
                first[[p["digit"] for p in places]] = [p["to"] for p in places]
                sizes = np.bincount(digit, minlength=1 << width)
                # Records of one digit keep their order, one place after the other.
                to = first[digit[order]] + np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                target = to // block_rows
                rows = []
                for a, b in _runs(target):
                    chunk = np.concatenate([to[None, a:b], records[:, order[a:b]]])
                    rows.append((int(target[a]), chunk.tobytes()))
                yield _to_batch(rows, [pa.int64(), pa.binary()], ["target", "chunk"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        chunks = np.concatenate([np.frombuffer(c, np.int64).reshape(_FIELDS + 1, -1) for c in pdf["chunk"]], axis=1)
        records = np.ascontiguousarray(chunks[1:, np.argsort(chunks[0])])
        row = _block_row(int(pdf["target"].iloc[0]), records, key, at + width, width)
        return pd.DataFrame([row], columns=["block", "records", "counts"])

    places = ws.write(_places(blocks, width), "places")
    size = places.agg(F.coalesce(F.sum(F.size("places") * 16 + 16), F.lit(0)).alias("n")).first()["n"]
    with_places = blocks.select("block", "records").join(F.broadcast(places) if size <= broadcast_bytes else places, "block")
    dealt = with_places.select("records", "places").mapInArrow(ta.tidy(deal), "target long, chunk binary")
    return ws.write(dealt.groupBy("target").applyInPandas(gather, _BLOCK), "sorted")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    yield from zip(np.append(0, cuts).tolist(), np.append(cuts, len(values)).tolist())


def ranked(
    rows: DataFrame, ws: Workspace, block_rows: int = BLOCK_ROWS, digit_bits: int = DIGIT_BITS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Written rows of :func:`scored` with ``rank`` = 1, 2, 3 … by score downwards, then id (null last), then features."""
    names = ("doc_id", "n_features", "score")
    ends = rows.agg(*(F.coalesce(f(c), F.lit(0)).alias(f"{k}_{c}") for k, f in (("low", F.min), ("high", F.max)) for c in names)).first()
    key = _Key({c: ends[f"low_{c}"] for c in names}, {c: ends[f"high_{c}"] for c in names})
    blocks = ws.write(_first_blocks(rows, key, digit_bits, block_rows), "blocks")
    for at in range(0, sum(key.bits), digit_bits):
        blocks = _pass(blocks, ws, key, at, digit_bits, block_rows, broadcast_bytes)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("records")):
                doc, null, *rest = _records(data.as_py())
                rank = np.arange(len(doc)) + block * block_rows + 1
                columns = [pa.array(doc, mask=null.astype(bool)), *map(pa.array, rest), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n_features", "weight", "score", "rank"])

    return blocks.select("block", "records").mapInArrow(
        ta.tidy(unpack), "doc_id long, print long, n_features long, weight long, score long, rank long"
    )


def resampled(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    workspace: Workspace | None = None, block_rows: int = BLOCK_ROWS, digit_bits: int = DIGIT_BITS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, print, n_features, weight, score, rank`` for every row of ``documents``.

    ``print`` is a hash of the text.  Of the rows with ``least_words`` words, ``percent``
    in a hundred are drawn, rounded down; their ``rank`` counts from the best score, that
    of all others is null.  Equal scores go by the smaller id, null ids last; rows that
    share their id as well go by fewer features, and in any order if those are equal too,
    which leaves the other columns of this result the same.  Null and empty texts have no
    features and weight 0.  Only ``doc_id`` and ``text`` are read; empty tables of either
    kind are allowed, and an empty table of documents gives no rows.
    """
    ws = workspace or Workspace(documents.sparkSession)
    table = gains(bucket_counts(documents), bucket_counts(target))
    rows = ws.write(scored(documents, table, seed), "scored")
    fit = rows.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = ranked(fit, ws, block_rows, digit_bits, broadcast_bytes)
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(rest.drop("n_words"))


def drawn_documents(documents: DataFrame, target: DataFrame, workspace: Workspace | None = None, **options) -> DataFrame:
    """The drawn rows of ``documents``, all columns as they are, whatever their names.

    Rows that agree in id and text are drawn together if one of them is.
    """
    ws = workspace or Workspace(documents.sparkSession)
    drawn = resampled(documents, target, workspace=ws, **options).filter("rank IS NOT NULL")
    drawn = drawn.select("doc_id", "print").distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("a"), F.xxhash64("text").alias("b"))
    same = F.col("a").eqNullSafe(F.col("doc_id")) & (F.col("b") == F.col("print"))
    return rows.join(drawn, same, "left_semi").select("row.*")


def resampling_digests(documents: DataFrame, target: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    return resampled(documents, target, workspace=workspace).drop("print")


# A CRC-32 of each distinct feature by a 256-entry table, both made by rule.
TWIN = r"""
WITH RECURSIVE steps(i, k, v) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
words AS (
    SELECT kind, id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark)),
features AS (
    SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT kind, id, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (
    SELECT f, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(0, length(h) // 2),
            lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
        lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)), crc_table),
buckets AS (
    SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t
    FROM counted JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM buckets, totals),
weights AS (
    SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
    FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
    SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (id) WHERE kind = 'd'),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS i, count(*) FILTER (n_words >= 20) OVER () AS fit
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND i <= 25 * fit // 100 THEN i END AS rank FROM ordered
"""

"""Exact n-gram Jaccard join: near-duplicate components of documents.

The documents by n-grams incidence matrix is cut into blocks, and everything that a size
bound rules out is dropped.  Pairs come from a prefix filter join and are verified on
whole sets; the matrix is not multiplied with its transpose:

1. Documents with equal n-gram sets are one class; a class is one row of the matrix.
2. The columns are cut into blocks by hash.  Every block finds the n-grams that occur
   once in the corpus; a document with more than a quarter of those can reach no other
   at the threshold and leaves the matrix.  Hashes travel as arrays, not as rows.
3. Of the rest, an n-gram's column is kept only for documents that have it among their
   rarest ones (the prefix that any partner must touch).
4. Columns give candidate pairs, first with one centre document per column, later only
   between documents that are not yet connected; so a column shared by many copies of
   one text costs a row per copy and not per pair.  Pairs are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wardlight.llm import textarrays as ta
from wardlight.llm.tables import BROADCAST_IDS, without_ids
from wardlight.operators.components import connected_components
from wardlight.workspace import Workspace

WORDS = 5
PERCENT = 75
#: Bytes of hashes that a block of columns holds.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose hashes travel together.
SEND_BYTES = 8 << 20
#: Rounds with one centre per column before all unconnected pairs are compared.
STAR_ROUNDS = 1
#: Longs of a set's sketch: a bit for each of its hash classes that holds an odd number of n-grams.
SKETCH = 16


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(batch: pa.RecordBatch, words: int, size: int = ta.BLOCK_BYTES):
    """For each block of a batch: its ids, and the distinct n-gram hashes of each text."""
    for block in ta.blocks(batch.column("text"), size):
        hashes, begins = ta.distinct(*ta.shingles(*block.words(), words))
        yield batch.column("doc_id").slice(block.first, block.last - block.first), hashes, begins


def _keys(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    both = []
    for salt in (0x1234567, 0x89ABCDEF01):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ta.mix(hashes ^ np.uint64(salt)))])
        both.append(ta.mix(sums[begins[1:]] - sums[begins[:-1]]).view(np.int64))
    return both[0], both[1]


def ngram_sets(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n, k1, k2``: the size of each row's n-gram set and a 128-bit key of the set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hashes, begins in _sets(batch, words):
                k1, k2 = _keys(hashes, begins)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(begins), pa.int64()), pa.array(k1), pa.array(k2)], ["doc_id", "n", "k1", "k2"]
                )

    return _texts(documents).mapInArrow(ta.tidy(describe), "doc_id long, n long, k1 long, k2 long")


def with_partners(documents: DataFrame, total: int, words: int, percent: int) -> DataFrame:
    """Ids of documents whose n-grams seen elsewhere reach the threshold (a superset: 32-bit hashes per block).

    ``total`` is the number of n-grams of all sets.
    """
    columns = max(16, -(-4 * total // BLOCK_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for ids, hashes, begins in _sets(batch, words):
                # A copy of the ids, so that the batch can go.
                waiting.append((np.array(ids.to_numpy(zero_copy_only=False)), hashes, begins))
                size += len(hashes)
                if size > SEND_BYTES // 8:
                    yield _blobs(waiting, number, columns)
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield _blobs(waiting, number, columns)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(d, "<u4") for d in pdf["hashes"]])
        again = pd.Series(hashes).duplicated(keep=False).to_numpy()
        seen = np.append(0, np.cumsum(again))
        # The texts of all blobs, one after another.
        sizes = [np.frombuffer(s, "<u4") for s in pdf["sizes"]]
        ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
        shared = np.diff(seen[ends], prepend=0).astype("<u4")
        cuts = np.cumsum([len(s) for s in sizes])
        out = [shared[end - len(s) : end].tobytes() for s, end in zip(sizes, cuts)]
        return pd.DataFrame({"block": pdf["block"], "ids": pdf["ids"], "shared": out})

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        shared = sum(np.frombuffer(s, "<u4").astype(np.int64) for s in pdf["shared"])
        ids, n = np.frombuffer(next(i for i in pdf["ids"] if i is not None), "<i8").reshape(2, -1)
        return pd.DataFrame({"node": ids[(n > 0) & (100 * shared >= percent * n)]})

    sent = _texts(documents).filter("doc_id is not null").mapInArrow(
        ta.tidy(send), "column int, block long, ids binary, sizes binary, hashes binary"
    )
    counted = sent.groupBy("column").applyInPandas(count, "block long, ids binary, shared binary")
    return counted.groupBy("block").applyInPandas(decide, "node long").distinct()


def _blobs(parts: list, number: int, columns: int) -> pa.RecordBatch:
    """One row per block of columns; the documents' ids and sizes go with one of them."""
    ids = np.concatenate([p[0] for p in parts]).astype("<i8")
    n = np.concatenate([np.diff(p[2]) for p in parts])
    hashes = np.concatenate([p[1] for p in parts])
    column = ((hashes >> np.uint64(32)) % np.uint64(columns)).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), n)
    sizes = np.bincount(column * len(ids) + row, minlength=columns * len(ids)).reshape(columns, -1).astype("<u4")
    data = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")[np.argsort(column, kind="stable")]
    ends = np.cumsum(sizes.sum(1))
    carrier = number % columns
    about = np.concatenate([ids, n.astype("<i8")]).tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(columns), pa.int32()), pa.array(np.full(columns, number), pa.int64()),
            pa.array([about if c == carrier else None for c in range(columns)], pa.binary()),
            pa.array([s.tobytes() for s in sizes], pa.binary()),
            pa.array([data[e - int(s.sum()) : e].tobytes() for s, e in zip(sizes, ends)], pa.binary()),
        ],
        ["column", "block", "ids", "sizes", "hashes"],
    )


def _odd_sketches(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs per set.  Two sets differ in at least as many n-grams as their sketches in bits."""
    bits, n = 64 * SKETCH, len(begins) - 1
    row = np.repeat(np.arange(n), np.diff(begins))
    odd = np.bincount(row * bits + (hashes % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def _hash_sets(documents: DataFrame, words: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hashes, begins in _sets(batch, words):
                k1, k2 = _keys(hashes, begins)
                lists = pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), pa.array(hashes.view(np.int64)))
                sketches = pa.FixedSizeListArray.from_arrays(pa.array(_odd_sketches(hashes, begins).ravel()), SKETCH)
                long_list = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(k1), pa.array(k2), lists.cast(long_list), sketches.cast(long_list)],
                    ["node", "k1", "k2", "grams", "sketch"],
                )

    return documents.mapInArrow(ta.tidy(emit), "node long, k1 long, k2 long, grams array<long>, sketch array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left, right = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", common.alias("_c"), (F.size("ga") + F.size("gb")).alias("_s"))
        .filter(100 * F.col("_c") >= percent * (F.col("_s") - F.col("_c")))
        .select("a", "b")
    )


def _fits(a: str, b: str, percent: int) -> str:
    return f"100L * least({a}, {b}) >= {percent}L * greatest({a}, {b})"


def links(sets: DataFrame, ws: Workspace, percent: int = PERCENT) -> DataFrame:
    """``node, label`` for the nodes of ``sets`` (``node, grams, sketch``): their components under the threshold.

    Only nodes that may have a partner are returned.
    """
    nodes = sets.select("node", F.size("grams").cast("long").alias("n"), "grams")
    entries = nodes.select("node", "n", F.explode("grams").alias("g"))
    often = entries.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    # A partner touches the first n - ceil(percent n / 100) + 1 n-grams, rarest first; unique ones lead.
    by_node = entries.join(often, "g").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("rare"))
    room = F.expr(f"int(n - ceil({percent} * n / 100.0) + 1 - (n - size(rare)))")
    postings = ws.write(
        by_node.withColumns({"_room": room, "own": 1 - F.size("rare") / F.col("n")}).filter("_room > 0")
        .select("node", "n", "own", F.explode(F.slice("rare", F.lit(1), F.col("_room"))).alias("e"))
        .select("node", "n", "own", "e.g"),
        "postings",
    )
    labels = postings.select("node", F.col("node").alias("label")).distinct()
    for step in range(STAR_ROUNDS + 1):
        # Columns that still meet more than one component.
        active = postings.join(labels, "node")
        if step:
            open_ = active.groupBy("g").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).filter("_l <> _m").select("g")
            active = ws.write(active.join(open_, "g"), "active")
            if active.limit(1).count() == 0:
                break
        if step < STAR_ROUNDS:
            # The document with the smallest share of n-grams of its own is the likeliest to link to many.
            first = F.struct("own", F.xxhash64("node", F.lit(step)))
            centre = active.groupBy("g").agg(F.min_by(F.struct("node", "n", "label"), first).alias("c"))
            met = active.join(centre, "g").filter("c.label <> label").filter(_fits("n", "c.n", percent))
            met = met.groupBy("node", F.col("c.node").alias("centre")).agg(F.count("*").alias("_c"))
            # One candidate per node: the centre it meets in most columns.
            met = met.groupBy("node").agg(F.max_by("centre", F.struct("_c", "centre")).alias("centre"))
        else:
            bits = [f"s{i}" for i in range(SKETCH)]
            mine = active.select("g", "node", "n", "label").join(
                sets.select("node", *(F.element_at("sketch", i + 1).alias(b) for i, b in enumerate(bits))), "node"
            )
            other = mine.toDF("centre", "g", "_n", "_l", *(f"_{b}" for b in bits))
            apart = " + ".join(f"bit_count({b} ^ _{b})" for b in bits)
            # Sets at the threshold differ in at most this share of their n-grams.
            near = f"{100 + percent} * ({apart}) <= {100 - percent} * (n + _n)"
            met = mine.join(other, "g").filter("label < _l").filter(_fits("n", "_n", percent)).filter(near)
            met = met.select("node", "centre").distinct()
        pairs = met.selectExpr("least(node, centre) AS a", "greatest(node, centre) AS b").distinct()
        found = _verified(ws.write(pairs, "pairs"), nodes, percent)
        # Only linked components are merged, by their labels.
        ends = found.join(labels.toDF("a", "src"), "a").join(labels.toDF("b", "dst"), "b").select("src", "dst")
        ends = ws.write(ends.distinct(), "links")
        if ends.limit(1).count():
            linked = ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct()
            merged = connected_components(linked, ends, ws).toDF("label", "_into")
            labels = ws.write(
                labels.join(merged, "label", "left").select("node", F.coalesce("_into", "label").alias("label")), "labels"
            )
    return labels


def near_duplicates(
    documents: DataFrame, words: int = WORDS, percent: int = PERCENT, workspace: Workspace | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents``.

    Two documents are linked when their sets of distinct ``words``-grams have a Jaccard
    similarity of at least ``percent`` / 100; a component's id is its smallest doc_id.
    Words are split at ASCII white space, A-Z lowered.  A text of fewer words is one
    n-gram; one without words (or null) has none and is linked with nothing.  Rows with
    the same doc_id are the same document and so in one component.  Rows without a
    doc_id are linked with nothing and get a null component.  Sets are compared by
    64-bit hashes of their n-grams.
    """
    ws = workspace or Workspace(documents.sparkSession)
    sets = ws.write(ngram_sets(documents, words), "sets")
    usable = sets.filter("doc_id is not null and n > 0")
    classes = ws.write(usable.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    texts = _texts(documents)
    # A class's first document stands for all its copies, so that they are no partners of each other.
    nodes = classes.select(F.col("node").alias("doc_id"))
    ones = without_ids(texts, sets.select("doc_id").join(nodes, "doc_id", "left_anti"), ws)
    survivors = ws.write(classes.join(with_partners(ones, total, words, percent), "node", "left_semi"), "survivors")
    few = survivors.select(F.col("node").alias("doc_id")).distinct()
    if few.count() <= BROADCAST_IDS:
        few = F.broadcast(few)
    kept = _hash_sets(texts.join(few, "doc_id", "left_semi"), words)
    # A row that shares its id with another text is no representative of a class.
    kept = kept.join(F.broadcast(survivors) if survivors.count() <= BROADCAST_IDS else survivors, ["node", "k1", "k2"], "left_semi")
    matrix = ws.write(kept.dropDuplicates(["node", "k1", "k2"]), "matrix")
    # Two classes of one doc_id keep apart until the end.
    matrix = matrix.select(F.col("k1").alias("node"), "grams", "sketch")
    labels = links(matrix, ws, percent)
    joined = classes.join(labels.select(F.col("node").alias("k1"), "label"), "k1", "left")
    group = ws.write(joined.withColumn("group", F.coalesce("label", "k1")), "groups")
    rows = usable.join(group.select("n", "k1", "k2", "group"), ["n", "k1", "k2"]).select("doc_id", "group")
    return _named(sets, ws.write(rows.distinct(), "members"), ws)


def _named(sets: DataFrame, members: DataFrame, ws: Workspace) -> DataFrame:
    """Give groups their smallest id; groups that share an id are one."""
    twice = members.groupBy("doc_id").agg(F.min("group").alias("src"), F.max("group").alias("dst")).filter("src <> dst")
    if twice.limit(1).count():
        also = members.groupBy("doc_id").agg(F.min("group").alias("src")).join(members, "doc_id").selectExpr("src", "group AS dst").filter("src <> dst")
        same = connected_components(members.selectExpr("group AS node"), also, ws).selectExpr("node AS group", "label AS _label")
        members = members.join(same, "group").selectExpr("doc_id", "_label AS group")
    smallest = members.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    names = members.join(smallest, "group").select("doc_id", "component_id").distinct()
    return sets.join(names, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(documents: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """``documents`` with one row of each near-duplicate component: that of the smallest id.

    Rows without an id stay; of rows with the same id one stays.
    """
    ws = workspace or Workspace(documents.sparkSession)
    found = ws.write(near_duplicates(documents, workspace=ws), "components")
    kept = without_ids(documents, found.filter("doc_id <> component_id"), ws)
    again = ws.write(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.limit(1).count() == 0:
        return kept
    several = kept.join(F.broadcast(again) if again.count() <= BROADCAST_IDS else again, "doc_id", "left_semi")
    return without_ids(kept, again, ws).unionByName(several.dropDuplicates(["doc_id"]))

"""Large JSON arrays of objects, read by many tasks.

The text reader cuts a file at every closing brace, in as many splits as the file has.
What a piece means depends on where it begins: inside a string or not, and how deep.
Each split is summed up for both cases, the sums of a file's splits are chained, and
then every split knows its beginning.  Objects that lie in one split are cut out there;
the fragments at the edges of splits are put together by a small shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wardlight.shipping import ship_package
from wardlight.workspace import Workspace

_ESCAPE = re.compile(rb"\\.", re.S)
_OPEN = re.compile(rb"[{\[]")
_CLOSE = re.compile(rb"[}\]]")
#: What may stand before an element.
_BETWEEN = b" \t\r\n,"
_SPLIT = "path string, start long"


def _step(piece: bytes, inside: int) -> tuple[int, int]:
    """(in a string afterwards, levels gained) for a piece without its brace, from outside or inside a string."""
    parts = (_ESCAPE.sub(b"", piece) if b"\\" in piece else piece).split(b'"')
    levels = 0
    for part in parts[inside::2]:
        levels += len(_OPEN.findall(part)) - len(_CLOSE.findall(part))
    return (inside + len(parts) - 1) % 2, levels


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its bytes and, for both beginnings, where it ends."""
    sums: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for path, start, piece in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "piece"))):
            # bytes, then for outside and inside: in a string afterwards, levels gained
            held = sums.setdefault((path, start), [0, 0, 0, 1, 0])
            held[0] += len(piece) + 1
            for at in (1, 3):
                held[at], gained = _step(piece, held[at])
                held[at + 1] += gained - (held[at] == 0)  # the brace counts outside of strings
    rows = [(*k, *v) for k, v in sums.items()]
    names = ["path", "start", "size", "end0", "levels0", "end1", "levels1"]
    kinds = [pa.string()] + [pa.int64()] * 6
    columns = list(zip(*rows)) or [()] * 7
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each split of a file begins; a file has a row per split here."""
    pdf = pdf.sort_values("start")
    inside, depth, states = 0, 0, []
    for row in pdf.itertuples():
        states.append((inside, depth))
        end, levels = (row.end1, row.levels1) if inside else (row.end0, row.levels0)
        inside, depth = end, depth + levels
    # A file that does not end with a brace has one byte less than its pieces.
    whole = int(pdf["size"].sum()) == int(pdf["bytes"].iloc[0])
    last = [False] * (len(pdf) - 1) + [True]
    return pd.DataFrame({
        "path": pdf["path"], "start": pdf["start"], "inside": [s[0] for s in states], "depth": [s[1] for s in states],
        "open_end": [not whole and x for x in last],
    })


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole elements (``part`` null), and the fragments at a split's beginning (0) and end (1)."""
    states: dict[tuple[str, int], list] = {}
    for batch in batches:
        rows = []
        columns = ("path", "start", "piece", "inside", "depth", "open_end")
        for path, start, piece, inside, depth, open_end in zip(*(batch.column(c).to_pylist() for c in columns)):
            key = path, start
            if key not in states:
                # in a string, depth, pieces held, whether they continue another split's, the piece before, open end
                states[key] = [inside, depth, [], bool(inside or depth > 1), None, open_end]
            held = states[key]
            if held[4] is not None:
                rows += _take(key, held, held[4], True)
            held[4] = piece
        yield _fragments(rows)
    rows = []
    for key, held in states.items():
        if held[4] is not None:
            rows += _take(key, held, held[4], not held[5])
        if held[2] or held[3]:
            rows.append((*key, 0 if held[3] else 1, b"".join(held[2]), held[3]))
    yield _fragments(rows)


def _take(key: tuple[str, int], held: list, piece: bytes, braced: bool) -> list[tuple]:
    inside, gained = _step(piece, held[0])
    held[0], held[1] = inside, held[1] + gained - (braced and inside == 0)
    held[2].append(piece + (b"}" if braced else b""))
    if inside or held[1] > 1 or not braced:
        return []
    text, continues = b"".join(held[2]), held[3]
    held[2], held[3] = [], False
    return [(*key, 0 if continues else None, text, False)]


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "start", "part", "element", "goes_on"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def read_elements(spark: SparkSession, path: str, workspace: Workspace | None = None) -> DataFrame:
    """``path, element``: the JSON text of every element of the arrays in these files.

    Only objects are elements; what else stands between them, and what is left of a file
    that breaks off, is a text of its own, which no JSON reader takes for an object.
    """
    ship_package(spark)
    ws = workspace or Workspace(spark)
    source = spark.read.option("lineSep", "}").text(path)
    pieces = source.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("bytes"), F.col("value").cast("binary").alias("piece"),
    )
    sums = pieces.select("path", "start", "piece").mapInArrow(
        _sum_up, f"{_SPLIT}, size long, end0 long, levels0 long, end1 long, levels1 long"
    )
    sizes = source.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).distinct()
    # Some 100 bytes per split of the input.
    states = ws.write(
        sums.join(sizes, "path").groupBy("path").applyInPandas(_chain, f"{_SPLIT}, inside long, depth long, open_end boolean"), "states"
    )
    cut = pieces.drop("bytes").join(F.broadcast(states), ["path", "start"]).mapInArrow(
        _cut, f"{_SPLIT}, part int, element binary, goes_on boolean"
    )
    cut = ws.write(cut, "elements")
    whole = cut.filter("part IS NULL").select("path", "element")
    # A fragment at an end opens an element, which those at the following beginnings continue.
    order = Window.partitionBy("path").orderBy("start", "part")
    opened = F.last(F.when(F.col("part") == 1, F.col("start")), ignorenulls=True).over(order)
    edges = cut.filter("part IS NOT NULL").withColumn("opened", opened)
    joined = edges.groupBy("path", "opened").agg(
        F.array_sort(F.collect_list(F.struct("start", (-F.col("part")).alias("late"), "element"))).alias("parts")
    )
    # The end of a split comes after its beginning, but opens the element: it has the smaller start.
    text = F.array_join(F.transform("parts", lambda p: p["element"].cast("string")), "")
    found = whole.select("path", F.col("element").cast("string").alias("element")).unionByName(joined.select("path", text.alias("element")))
    return found.select("path", F.explode(_split_off(F.col("element"))).alias("element"))


def _split_off(text):
    """An element's own text, and before it whatever is neither white space, a comma nor the array's beginning."""
    at = F.instr(text, "{")
    # A text without an object is all between.
    before = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    own = F.when(at > 0, F.substring(text, at, F.length(text)))
    rest = F.trim(F.regexp_replace(before, r"^[\s,]*\[|\][\s]*$|^[\s,]+|[\s,]+$", ""))
    return F.filter(F.array(F.nullif(rest, F.lit("")), own), lambda x: x.isNotNull())

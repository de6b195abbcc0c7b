"""Line dedup: lines that several documents hold stay in one of them only.

Normalised lines are exploded and hashed; the documents that hold a hash are counted
with partial sums, so a line of a third of all documents is one row per task.  Lines
over the threshold are marked by position, and texts are put together again from the
positions that stay.  Everything is DataFrame work; texts move only if the marks
outgrow a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight.operators import joins
from wardlight.workspace import Workspace

#: Documents that must hold a line before it is dropped, and its least length in code points.
LEAST_DOCUMENTS = 3
LEAST_CHARS = 20
#: Bytes of repeated keys, and of marks, that may be broadcast.
BROADCAST_BYTES = 32 << 20
_KEY_BYTES = 48
_MARK_BYTES = 64

_WHITE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(_WHITE))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(of: str) -> list[Column]:
    """128 bits: two hashes of different seeds."""
    return [F.xxhash64(of).alias("h"), F.xxhash64(F.lit(1), of).alias("h2")]


def _keyed(documents: DataFrame, *more: Column) -> DataFrame:
    """``doc, text`` and, in ``a, b``, a fingerprint of both that joins marks to rows."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )
    return rows.withColumns({"a": F.xxhash64("doc", "text"), "b": F.xxhash64(F.lit(1), "doc", "text")})


def repeated_lines(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """``h, h2, documents, keeper``: the hashed lines that so many documents hold.

    ``keeper`` is the largest doc_id among them.  Each row counts as a document.
    """
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= least_chars)
    return (
        _keyed(documents).select("doc", F.explode(F.array_distinct(keys)).alias("line"))
        .select("doc", *_hashes("line"))
        .groupBy("h", "h2").agg(F.count("*").alias("documents"), F.max("doc").alias("keeper"))
        .filter(F.col("documents") >= least_documents)
    )


def _marks(rows: DataFrame, repeated: DataFrame, least_chars: int, hot_rows: int, broadcast_bytes: int) -> DataFrame:
    """``a, b, drop``: for each document with lines to drop, their positions in order."""
    lines = (
        rows.select("doc", "a", "b", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
        .select("doc", "a", "b", "at", line_key(F.col("line")).alias("line"))
        .filter(F.char_length("line") >= least_chars)
        .select("doc", "a", "b", "at", *_hashes("line"))
    )
    small = repeated.count() * _KEY_BYTES <= broadcast_bytes
    if small:
        found = lines.join(F.broadcast(repeated), ["h", "h2"])
    else:
        # So many documents hold a hot line that its rows must not meet in one task; hot lines are few.
        hot = repeated.filter(F.col("documents") > hot_rows)
        found = lines.join(repeated.filter(F.col("documents") <= hot_rows), ["h", "h2"])
        if joins.has_rows(hot):
            found = found.unionByName(lines.join(F.broadcast(hot), ["h", "h2"]))
    # Repeated rows bring the same positions, which a set takes once.
    return (
        found.filter(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("a", "b").agg(F.sort_array(F.collect_set("at")).alias("drop"))
    )


def _without(text: Column, drop: Column) -> Column:
    """The lines outside ``drop``, in order; linear in both."""
    gaps = F.slice(F.zip_with(drop, F.concat(F.array(F.lit(-1)), drop), lambda at, before: at - before - 1), 1, F.size(drop))
    mask = F.flatten(F.transform(gaps, lambda gap: F.concat(F.array_repeat(F.lit(False), gap), F.array(F.lit(True)))))
    marked = F.zip_with(lines_of(text), mask, lambda line, gone: F.when(F.coalesce(gone, F.lit(False)), None).otherwise(line))
    return F.array_join(F.filter(marked, lambda line: line.isNotNull()), "\n")


def _marked(
    documents: DataFrame, ws: Workspace, least_documents: int, least_chars: int, hot_rows: int, broadcast_bytes: int, *more: Column
) -> DataFrame:
    """``doc, text, drop`` and the further columns for every row; ``drop`` is null where all lines stay."""
    repeated = ws.write(repeated_lines(documents, least_documents, least_chars), "repeated")
    marks = ws.write(_marks(_keyed(documents), repeated, least_chars, hot_rows, broadcast_bytes), "marks")
    rows = _keyed(documents, *more)
    size = marks.agg(F.coalesce(F.sum(F.size("drop") * 4 + _MARK_BYTES), F.lit(0)).alias("n")).first()["n"]
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(marks), ["a", "b"], "left")
    return joins.lookup(rows, marks, ["a", "b"], "left", broadcast_rows=0, hot_rows=hot_rows)


def line_digests(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS,
    workspace: Workspace | None = None, hot_rows: int = joins.HOT_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row of ``documents``.

    A line goes if its key (:func:`line_key`) has ``least_chars`` code points and
    ``least_documents`` rows hold it, unless the row has the largest doc_id of them.
    Rows that share that id all keep it; a null id is smaller than any other, and where
    all ids are null the line stays.  A null or empty text is one empty line.  Repeated
    rows are counted and treated one by one, alike.  Other columns are not read; an empty
    table gives no rows.
    """
    ws = workspace or Workspace(documents.sparkSession)
    rows = _marked(documents, ws, least_documents, least_chars, hot_rows, broadcast_bytes)
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("drop")))
    return rows.select(
        F.col("doc").alias("doc_id"),
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def without_repeated_lines(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS,
    workspace: Workspace | None = None, hot_rows: int = joins.HOT_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``documents`` with the repeated lines cut out of their texts, by the rule of :func:`line_digests`.

    All columns stay, whatever their names; texts without such lines, null ones too, are unchanged.
    """
    ws = workspace or Workspace(documents.sparkSession)
    rows = _marked(documents, ws, least_documents, least_chars, hot_rows, broadcast_bytes, F.struct("*").alias("row"))
    cut = F.col("row").withField("text", _without(F.col("text"), F.col("drop")))
    return rows.select(F.when(F.col("drop").isNull(), F.col("row")).otherwise(cut).alias("row")).select("row.*")


TWIN = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keys AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
repeated AS (
    SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
kept AS (
    SELECT doc_id, pos, line, coalesce(keeper <> doc_id, false) AS gone FROM keys LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

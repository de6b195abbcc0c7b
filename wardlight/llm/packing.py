"""Best-fit packing of tokenised documents by length patterns.

Only the histogram of piece lengths (at most ``limit`` numbers, whatever the corpus)
reaches the driver.  There, patterns of two or three length bins that fill a sequence
are fitted to the histogram by non-negative least squares, rounded down and turned into
exact lengths; what is left is packed best fit first, whole groups of equal sequences at
a time.  The pieces then look up their place by their rank among pieces of their length.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wardlight.llm.tables import number
from wardlight.llm.textarrays import forget_for_others, tidy
from wardlight.workspace import Workspace

LIMIT = 2048
#: Token appended to every document.
END_ID = 0
#: Width of the bins of the fitted patterns, as a part of the limit.
BINS = 64
#: Words whose ids a task remembers: so many of late, and as many from before.
CACHE_WORDS = 200_000
#: Words of letters that are tokenised as one text.
JOINED = 256
#: Bytes of text, and words, that are worked on together.
BLOCK_BYTES, BLOCK_WORDS = 1 << 20, 1 << 18
#: Signs, and the small letters and last bytes of U+00C0 to U+00FF, between which the tokenizer always splits.
_SIGN, _SMALL, _LATIN = np.zeros((3, 256), bool)
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_SMALL[0x61:0x7B] = True
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True  # neither of the signs for times and divided by
_SPACES = bytes.maketrans(b"\n\t\r", b"   ")
_LOWER_SPACES = bytes.maketrans(b"\n\t\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"   abcdefghijklmnopqrstuvwxyz")
_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_tokenizers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of whole texts, tokenised word by word with a bounded memory of words.

    For tokenizers that lower case, drop white space, never look across it and split
    letters from punctuation, the ids of a text are those of its space-separated parts,
    so a word seen before costs one look-up per block of texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        #: Words used of late, and those used before; the latter are forgotten when the former are too many.
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        """The ids of UTF-8 bytes, as little-endian unsigned 32-bit numbers."""
        return next(self.ids_of([text]))

    def ids_of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each of several texts, which are worked on together."""
        words = pc.split_pattern(_parted([_plain(t) for t in texts]), b" ")
        ends = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        data, at = _data(coded.dictionary), _offsets(coded.dictionary)
        at = (at - at[0]).tolist()
        known = pa.array(self._look_up([data[i:j] for i, j in zip(at, at[1:])]), pa.large_binary())
        of, begin = coded.indices, 0
        if len(of) <= BLOCK_WORDS:
            taken = known.take(of)
            data, at = _data(taken), [0, *_offsets(taken)[ends].tolist()]
            yield from (data[i:j] for i, j in zip(at, at[1:]))
            return
        for end in ends.tolist():
            # Slices of words, so that a long text needs little besides its ids.
            some = [known.take(of[i : min(end, i + BLOCK_WORDS)]) for i in range(begin, end, BLOCK_WORDS)]
            yield b"".join([_data(part) for part in some])
            begin = end

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self._young.get, words))
        others = [w for w, ids in zip(words, found) if ids is None]
        again = {w: self._old[w] for w in others if w in self._old}
        self._young |= again
        learned = again | self._learn([w for w in others if w and w not in again])
        learned[b""] = b""
        return [learned[w] if ids is None else ids for w, ids in zip(words, found)]

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        learned: dict[bytes, bytes] = {}
        texts = [w.decode() for w in missing]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        for k in range(0, len(plain), JOINED):
            chosen = plain[k : k + JOINED]
            learned |= self._learn_plain([missing[i] for i in chosen], [texts[i] for i in chosen])
        learned |= self._learn_each([w for w in missing if w not in learned])
        for w, ids in learned.items():
            if len(self._young) >= CACHE_WORDS:
                self._old, self._young = self._young, {}
            self._young[w] = ids
        return learned

    def _learn_plain(self, words: list[bytes], texts: list[str]) -> dict[bytes, bytes]:
        """Tokenise words of letters together; each ends with the only token that ends a word."""
        (found,) = self._tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return self._learn_each(words)
        data, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
        return {word: data[begin:end] for word, begin, end in zip(words, ends, ends[1:])}

    def _learn_each(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self._tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: _as_bytes(e.ids) for w, e in zip(words, found)}


def _plain(text: bytes) -> bytes:
    """White space as blanks and A-Z lowered."""
    # A combining mark may compose with a small letter only, and a special token is
    # spelled in small letters: such texts keep their capitals.
    mixed = b"\xcc" in text or b"\xcd" in text or b"<|" in text
    return text.translate(_SPACES if mixed else _LOWER_SPACES)


def _parted(texts: list[bytes]) -> pa.LargeBinaryArray:
    """The texts with a blank between each letter and the sign after it.

    The tokenizer ends a part there whatever comes before or after, so the ids stay the
    same, and words are met without their punctuation.  Texts in which a special token
    may stand are left as they are, and so are letters beyond U+00FF.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.flatnonzero(_SIGN[data[1:]]) + 1
    before = data[at - 1]
    latin = _LATIN[before] & (at > 1) & (data[at - 2] == 0xC3)
    at = at[_SMALL[before] | latin]
    text = np.searchsorted(offsets, at, "right") - 1
    special = np.fromiter((b"<|" in t for t in texts), bool, len(texts))
    inside = (at > offsets[text]) & ~special[text]
    at, text = at[inside], text[inside]
    offsets[1:] += np.cumsum(np.bincount(text, minlength=len(texts)))
    data = np.insert(data, at, 0x20)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _offsets(strings: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]


def _data(strings: pa.LargeBinaryArray) -> bytes:
    begin, end = _offsets(strings)[[0, -1]].tolist()
    return strings.buffers()[2][begin:end].to_pybytes() if end > begin else b""


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
        forget_for_others("packing", _tokenizers.clear)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of a batch, some ``BLOCK_BYTES`` at a time."""
    docs, texts, size = [], [], 0
    for doc, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary())):
        docs.append(doc.as_py())
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= BLOCK_BYTES:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def pieces(documents: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32``.

    A document's ids are those of its text (null: empty) and the end id.  Only documents
    longer than ``limit`` are cut, every ``limit`` ids.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for docs, texts in _blocks(batch):
                for doc, ids in zip(docs, tokens.ids_of(texts)):
                    ids += end
                    for i in range(0, len(ids), 4 * limit):
                        part = ids[i : i + 4 * limit]
                        rows.append((doc, i // (4 * limit), i // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(tidy(cut, "packing"), _PIECE_SCHEMA)


def fit_counts(patterns: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """Counts x >= 0 that minimise |A x - target|^2, by accelerated projected gradients.

    ``patterns`` lists the bins of each pattern (0: none); column j of A counts the bins
    of pattern j.  Longer bins weigh more, as they are harder to place later.
    """
    n = len(target)
    weight = np.sqrt(np.arange(n) / (n - 1))
    flat = patterns.ravel()

    def product(x):
        out = np.bincount(flat, np.repeat(x, patterns.shape[1]), minlength=n)
        out[0] = 0
        return out

    v = np.ones(len(patterns))
    for _ in range(30):
        w = (weight**2 * product(v))[patterns].sum(1)
        scale = np.linalg.norm(w)
        v = w / scale
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        miss = product(y) - target
        miss[0] = 0
        new = np.maximum(0, y - (weight**2 * miss)[patterns].sum(1) / scale)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, limit: int = LIMIT, bins: int = BINS) -> list[tuple[int, list[int]]]:
    """Groups of equal sequences, as (number of sequences, lengths of their pieces).

    ``histogram[l]`` is the number of pieces of length l.  The groups use every piece
    exactly once; their number follows from the number of distinct lengths.
    """
    left = np.array(histogram, np.int64)
    if len(left) != limit + 1 or left[0] or (left < 0).any():
        raise ValueError("a histogram of the lengths 1 to limit is needed")
    groups: list[tuple[int, list[int]]] = []
    if left[limit]:
        groups.append((int(left[limit]), [limit]))
        left[limit] = 0
    open_: list[tuple[int, list[int]]] = []
    width = limit / bins
    if bins >= 3 and left.any():
        # Bin b holds the lengths that round to b bin widths.
        of = np.clip(np.rint(np.arange(limit + 1) / width).astype(int), 1, bins - 1)
        of[0] = 0
        target = np.bincount(of, left, minlength=bins + 1).astype(float)
        some = [b for b in range(1, bins) if target[b]]
        patterns = [
            (a, b, bins - a - b) for a in some for b in some
            if a >= b and 0 <= bins - a - b <= b and (a + b == bins or target[bins - a - b])
        ]
        if patterns:
            counts = np.floor(fit_counts(np.array(patterns), target) + 1e-9).astype(int)
            lengths = {b: [int(v) for v in np.flatnonzero(of == b)] for b in range(1, bins)}
            for j in np.argsort(-counts, kind="stable"):
                open_ += _realise([lengths[b] for b in patterns[j] if b], int(counts[j]), left, limit)
    return groups + _best_fit(left, open_, limit)


def _realise(bins: list[list[int]], count: int, left: np.ndarray, limit: int) -> list[tuple[int, list[int]]]:
    """Sequences of one pattern with exact lengths: the longest that are left, the last one to fit."""
    made = []
    while count > 0:
        chosen: list[int] = []
        room = limit
        for choices in bins:
            length = next(
                (v for v in reversed(choices) if v <= room and left[v] > chosen.count(v)), None
            )
            if length is None:
                return made
            chosen.append(length)
            room -= length
        n = min(count, *(int(left[v]) // chosen.count(v) for v in chosen))
        for v in chosen:
            left[v] -= n
        made.append((n, chosen))
        count -= n
    return made


def _best_fit(left: np.ndarray, open_: list[tuple[int, list[int]]], limit: int) -> list[tuple[int, list[int]]]:
    """Put the remaining pieces, longest first, where the least room stays."""
    rooms: list[list[tuple[int, list[int]]]] = [[] for _ in range(limit + 1)]
    held = np.zeros(limit + 1, bool)

    def keep(n: int, lengths: list[int]) -> None:
        room = limit - sum(lengths)
        rooms[room].append((n, lengths))
        held[room] = True

    for n, lengths in open_:
        keep(n, lengths)
    for length in range(limit, 0, -1):
        while left[length] > 0:
            fits = np.flatnonzero(held[length:])
            n, lengths = rooms[length + fits[0]].pop() if len(fits) else (None, [])
            room = limit - sum(lengths)
            if n is not None and not rooms[room]:
                held[room] = False
            have = int(left[length])
            each = min(room // length, have)
            used = have // each if n is None else min(n, have // each)
            if n is not None and n > used:
                keep(n - used, lengths)
            keep(used, lengths + [length] * each)
            left[length] -= used * each
    return [group for room in rooms for group in room]


class Places:
    """The planned place of every piece, looked up by its rank in the order of lengths."""

    def __init__(self, groups: list[tuple[int, list[int]]], histogram: np.ndarray):
        begin = np.concatenate([[0], np.cumsum(histogram)])[:-1].astype(np.int64)
        used = begin.copy()
        rows, sequence = [], 0
        for n, lengths in groups:
            offset = 0
            for length in lengths:
                rows.append((used[length], sequence, offset))
                used[length] += n
                offset += length
            sequence += n
        rows.sort()
        self.rank, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 3).T.copy()

    def find(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.rank, rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def pack_documents(
    documents: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, workspace: Workspace | None = None
) -> DataFrame:
    """Pack every document into sequences of at most ``limit`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per
    piece.  Null and empty texts are documents of the end id alone.  Repeated rows are
    packed as documents of their own.  An empty table gives no rows.  Other columns are
    ignored.
    """
    ws = workspace or Workspace(documents.sparkSession)
    cut = ws.write(pieces(documents, tokenizer, limit), "pieces")
    ranked = number(cut, [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank", ws)
    histogram = np.zeros(limit + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most `limit` rows
        histogram[row["length"]] = row["count"]
    places = Places(plan(histogram, limit), histogram)

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("_place", place("_rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset"
    )

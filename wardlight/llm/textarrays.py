"""Words, shingles and byte windows of many texts at once, as numpy arrays.

Everything here works on one block of texts laid end to end as UTF-8 bytes, so that a
hash costs a few array operations instead of a Python call.  Blocks hold about
``BLOCK_BYTES``; a longer text makes a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together.
BLOCK_BYTES = 1 << 19
#: Rows that are copied together.
SLICE_ROWS = 512

_U = np.uint64
_BYTE_VALUES = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER_VALUES = _BYTE_VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    h = h ^ (h >> _U(31))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


def _power(n: int, inverse: bool) -> np.ndarray:
    """BASE ** i (or its inverse) modulo 2**64 for i < n."""
    name = "inverse" if inverse else "plain"
    if name not in _powers or len(_powers[name]) < n:
        base = pow(_BASE, -1, 2**64) if inverse else _BASE
        steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        table = np.cumprod(steps)
        if n > 4 * BLOCK_BYTES:
            return table[:n]
        _powers[name] = table
    return _powers[name][:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return _LOWER[data]


class Block:
    """Rows ``first`` to ``last`` of a batch: their bytes and where each text begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first = first
        self.data = data
        self.offsets = offsets
        self._prefix: np.ndarray | None = None

    @property
    def last(self) -> int:
        return self.first + len(self.offsets) - 1

    def prefix(self, lower: bool = False) -> np.ndarray:
        """Prefix sums from which the hash of any substring follows."""
        if self._prefix is None:
            values = (_LOWER_VALUES if lower else _BYTE_VALUES)[self.data]
            values *= _power(len(values), False)
            self._prefix = np.empty(len(values) + 1, np.uint64)
            self._prefix[0] = 0
            np.cumsum(values, out=self._prefix[1:])
        return self._prefix

    def spans(self, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the substrings ``begin[i]:end[i]``."""
        p = self.prefix(lower)
        return mix((p[end] - p[begin]) * _power(len(p), True)[begin] + (end - begin).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        """The hashes of all substrings of ``size`` bytes, as :meth:`spans` gives them."""
        p = self.prefix()
        sums = p[size:] - p[:-size]
        sums *= _power(len(sums), True)
        sums += _U(size)
        return mix(sums)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and where each text's words begin."""
        begin, end = self.word_spans()
        return self.spans(begin, end, lower=True), np.searchsorted(begin, self.offsets).astype(np.int64)

    def word_spans(self, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the runs of bytes that are not marked in ``apart``."""
        solid = ~apart[self.data]
        begins, ends = solid.copy(), np.empty(len(solid), bool)
        begins[1:] &= ~solid[:-1]
        starts = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[starts] = solid[starts]
        ends[:-1] = solid[:-1] & (~solid[1:] | begins[1:])
        ends[-1:] = solid[-1:]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column of strings (null: empty) into blocks of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # Slices of rows, so that a batch is not copied as a whole.
    for begin in range(0, len(texts), SLICE_ROWS):
        part = pc.fill_null(texts.slice(begin, SLICE_ROWS).cast(pa.large_binary()), b"")
        _, where, what = part.buffers()
        offsets = np.frombuffer(where, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(part):
            last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            last = min(max(last, first + 1), len(part))
            yield Block(begin + first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last


def release_memory() -> None:
    """Hand freed memory back to the system, tables of powers too; workers live on after a task."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


#: What to do before a task of another operator: a worker lives through many, and what it remembers adds up.
_forget: dict[str, Callable[[], None]] = {}


def forget_for_others(owner: str, function: Callable[[], None]) -> None:
    """Have ``function`` drop what ``owner``'s tasks remember when another operator's task begins."""
    _forget[owner] = function


def tidy(function: Callable, owner: str = "") -> Callable:
    """A function for ``mapInArrow`` that releases memory at the end of its task, and what other owners remember before."""

    def run(batches):
        others = [name for name in _forget if name != owner]
        for name in others:
            _forget.pop(name)()
        if others:
            release_memory()
        yield from function(batches)
        release_memory()

    return run


def shingles(words: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``k`` words (a shorter text: all its words as one run).

    Returns the hashes with repeats in text order, and where each text's hashes begin.
    """
    counts = np.diff(begins)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    hashes = np.empty(out[-1], np.uint64)
    full = counts >= k
    if full.any():
        runs = _runs(words, k)
        at = np.repeat(begins[:-1][full] - out[:-1][full], made[full]) + _ranges(out[:-1][full], made[full])
        hashes[_ranges(out[:-1][full], made[full])] = runs[at]
    for n in range(1, k):
        some = counts == n
        if some.any():
            acc = np.full(int(some.sum()), n, np.uint64)
            for j in range(n):
                acc = mix(acc * _U(_BASE) + words[begins[:-1][some] + j])
            hashes[out[:-1][some]] = acc
    return hashes, out


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = mix(acc * _U(_BASE) + words[j : j + n])
    return acc


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, … (size[0] numbers), begin[1], …"""
    total = int(size.sum())
    before = np.repeat(np.cumsum(size) - size, size)
    return np.arange(total, dtype=np.int64) - before + np.repeat(begin, size)


ranges = _ranges


def distinct(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats."""
    hashes = hashes.copy()
    for a, b in zip(begins[:-1], begins[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begins[:-1][np.diff(begins) > 0]] = True
    return hashes[new], np.append(0, np.cumsum(new))[begins]

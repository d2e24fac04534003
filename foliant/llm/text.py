"""Vectorised text access for the operators that need Python.

A whole Arrow column is turned into one array of code points, and words are
found and hashed with prefix sums, so no Python loop runs per row or per word.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_TILE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_fold: np.ndarray | None = None
_kept: dict[str, tuple[Hashable, Any]] = {}
_powers: tuple[np.ndarray, np.ndarray] | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, digit or underscore, else 0."""
    global _fold
    if _fold is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c == "_" or unicodedata.category(c)[0] in "LN":
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _fold = table
    return _fold


#: Models of which a worker keeps one at a time: stages follow each other in it.
_LARGE = ("vocabulary", "automata")


def kept(kind: str, make: Callable[[], Any], key: Hashable = None) -> Any:
    """What a worker made before under this key, or make() now; a large model
    takes the place of the other kinds."""
    if kind not in _kept or _kept[kind][0] != key:
        for k in _LARGE if kind in _LARGE else (kind,):
            _kept.pop(k, None)
        _kept[kind] = (key, make())
    return _kept[kind][1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); x is left as it is."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows in a row, n + 1 offsets); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows in a row, n + 1 offsets); null counts as empty."""
    data, edges = utf8(texts)
    points = np.frombuffer(str(memoryview(data), "utf-8").encode("utf-32-le"), dtype=np.uint32)
    if len(points) == len(data):
        return points, edges
    # a code point begins at each byte that doesn't continue one
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[edges]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, n + 1 offsets of the rows' words).

    A word is a longest run of letters, digits and underscores. The hash is a
    polynomial over its code points modulo 2^64, finalised.
    """
    points, ends = codepoints(texts)
    folded = fold_table()[points]
    del points
    word = np.zeros(len(folded) + 1, dtype=bool)
    word[:-1] = folded != 0
    first = word[:-1].copy()
    first[1:] &= ~word[:-2]
    inner = ends[:-1][ends[:-1] < len(folded)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    last = word[:-1].copy()
    last[:-1] &= ~word[1:-1] | first[1:]
    stops = np.flatnonzero(last) + 1
    rows = np.searchsorted(starts, ends).astype(np.int64)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(stops, low + _TILE, side="right")))
        high = stops[to - 1]
        up, down = _pow(high - low)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(folded[low:high] * up, out=total[1:])
        s, e = starts[at:to] - low, stops[at:to] - low
        out[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return mix(out), rows

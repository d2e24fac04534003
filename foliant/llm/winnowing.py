"""Winnowing: position-keeping fingerprints of documents.

A text is reduced to its letters, digits and underscores in lower case, each
k-gram of what is left gets a rolling hash, and of every window of ``window``
k-grams in a row the least hash is kept, the rightmost of equal ones. So any
passage of ``k + window - 1`` letters that two texts share has a fingerprint in
both; a shared passage below ``k`` letters never has one.

Map only: one scan, no shuffle. Hashes are made a tile at a time; a text's letters
are held whole, some 16 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.frames import col
from foliant.llm.text import codepoints, fold_table, slices

K, WINDOW = 25, 50
#: The rolling hash is a polynomial in this base modulo 2^64; a fingerprint is
#: its upper 63 bits, and k-grams are compared by its upper 47.
BASE = 0xD1342543DE82EF95
_LOW = 17
_TILE = 1 << _LOW
_powers: tuple[np.ndarray, np.ndarray] | None = None


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, each from two prefix sums."""
    global _powers
    n = len(points)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    if _powers is None or len(_powers[0]) < n:
        up = np.full(max(n, _TILE), BASE, dtype=np.uint64)
        down = np.full(len(up), pow(BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    up, down = _powers
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(points * down[:n], out=total[1:])
    out = total[k:] - total[:-k]
    out *= up[: len(out)]
    out *= np.uint64(pow(BASE, k - 1, 1 << 64))
    return out


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window its least hash's place, the rightmost of equals.

    The place, counted from the right, takes the bits that comparison leaves.
    """
    low = np.uint64((1 << _LOW) - 1)
    keys = (hashes | low) - np.arange(len(hashes), dtype=np.uint64)
    n = 1
    while n * 2 <= window:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    if rest := window - n:
        keys = np.minimum(keys[:-rest], keys[rest:])
    return (low - (keys & low)).astype(np.int64)


def fingerprint(points: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of one text's fingerprints, in order."""
    grams = len(points) - k + 1
    if grams < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    window = min(window, grams)
    places, found = [], []
    last = -1
    step = _TILE - window - k
    for t in range(0, grams - window + 1, step):
        to = min(t + step, grams - window + 1)
        hashes = rolling(points[t : to + window - 1 + k - 1], k)
        at = _least(hashes, window)
        new = np.empty(len(at), dtype=bool)
        new[0] = at[0] + t != last
        new[1:] = at[1:] != at[:-1]
        at = at[new]
        if len(at):
            last = int(at[-1]) + t
            places.append(at + t)
            found.append((hashes[at] >> np.uint64(1)).astype(np.int64))
    return np.concatenate(places), np.concatenate(found)


def _rows(batches: Iterator[pa.RecordBatch], k: int, window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    fold = fold_table()
    for batch in batches:
        for part in slices(batch, batch.schema.names[1]):
            points, ends = codepoints(part.column(1))
            folded = fold[points]
            kept = np.flatnonzero(folded)
            folded = folded[kept]
            bounds = np.searchsorted(kept, ends)
            # all texts of the slice at once: windows that cross a boundary go
            places, hashes, rows = _many(folded, bounds, k, window)
            if len(places):
                ids = part.column(0).take(pa.array(rows))
                at = kept[places] - ends[rows]
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(hashes)], schema=schema)


def _many(folded: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(bounds)
    usual = sizes >= k + window - 1
    places, hashes, owners = [], [], []
    # short texts have one window: their k-grams are fewer than it
    for r in np.flatnonzero((sizes >= k) & ~usual):
        p, h = fingerprint(folded[bounds[r] : bounds[r + 1]], k, window)
        places.append(p + bounds[r])
        hashes.append(h)
        owners.append(np.full(len(p), r))
    total = len(folded)
    if usual.any():
        last = -1
        wide = k + window - 1
        step = _TILE - wide
        crossing = np.ones(total, dtype=bool)  # windows that run past their text's end
        for r in np.flatnonzero(usual):
            crossing[bounds[r] : bounds[r + 1] - wide + 1] = False
        for t in range(0, total - wide + 1, step):
            to = min(t + step, total - wide + 1)
            hs = rolling(folded[t : to + wide - 1], k)
            at = _least(hs, window)[~crossing[t:to]]
            if not len(at):
                continue
            new = np.empty(len(at), dtype=bool)
            new[0] = at[0] + t != last
            new[1:] = at[1:] != at[:-1]
            at = at[new]
            if len(at):
                last = int(at[-1]) + t
                places.append(at + t)
                hashes.append((hs[at] >> np.uint64(1)).astype(np.int64))
                owners.append(np.searchsorted(bounds, at + t, side="right") - 1)
    if not places:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(owners)


def winnow(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, fingerprint) of every document, whole texts.

    ``pos`` is the 0-based code point at which the k-gram starts in the text as
    it is. A null or empty text, or one of fewer than ``k`` letters, has no rows;
    one of fewer than ``window`` k-grams has the least of them. Long texts are
    worked on whole. Repeated rows give repeated fingerprints, a null id stays null, other columns are ignored,
    an empty table gives none.
    """
    if k < 1 or window < 1 or k + window > _TILE // 2:
        raise ValueError(f"k and window are at least 1, and together at most {_TILE // 2}")
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("pos", T.LongType()), T.StructField("fingerprint", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        for batch in batches:
            schema = pa.schema([pa.field("doc_id", batch.schema.field(0).type), pa.field("pos", pa.int64()), pa.field("fingerprint", pa.int64())])
            yield from _rows([batch], k, window, schema)

    return narrow.mapInArrow(rows, out)


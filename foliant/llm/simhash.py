"""SimHash near-duplicate groups, found by random bit sampling.

Each text gets 256 bits: bit by bit the majority over its distinct words'
hashes. Equal fingerprints collapse first, exactly. Then several tables group the
distinct fingerprints by sampled coordinates, as many as keep a bucket small for
the number of fingerprints there are, and as many tables as find a pair at
``RADIUS`` with a chance of ``RECALL`` all the same. A bucket beyond ``cap`` is
split by more coordinates of the same table, again and again, at first several times
over by different ones, so that a pair which some of them part still meets; one that
they can't split is compared in full. Every pair that shares a bucket is verified by
its Hamming distance, and groups are the connected components of the verified pairs.

Buckets are compared inside partitions sorted by bucket; what leaves one is a
star per component found there, not its pairs. Components are merged by
alternating stars, each round written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.frames import col, fresh, removed, written
from foliant.llm.text import mix, slices, words

WORDS = 4
BITS = 64 * WORDS
RADIUS = 44
#: Coordinates sampled at least, fingerprints to a bucket about, the chance to find
#: a pair at RADIUS, and fingerprints from which a bucket is split.
SAMPLED, PER_BUCKET, RECALL, CAP = 16, 64, 0.9, 1024
_PAIRS = 1 << 22
#: Coordinates more by which a large bucket is split, and how often over, by round.
_MORE, _OVER = 4, (4, 2, 1, 1, 1, 1, 1, 1, 1, 1)
_RUN = 65_535
_PARTS = ["f0", "f1", "f2", "f3"]


def sketch(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """n x 4 words of bits, from word hashes and the n + 1 offsets of the rows."""
    n = len(rows) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(rows))
    _, first = np.unique(hashes ^ mix(owner), return_index=True)
    first.sort()
    own, distinct = owner[first].astype(np.int64), hashes[first]
    counts = np.bincount(own, minlength=n)
    some = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]]).astype(np.int64)
    out = np.zeros((n, WORDS), dtype=np.uint64)
    if not len(some):
        return out
    # four counters of 16 bits add up in each word; longer runs are cut for it
    cuts, runs = starts, np.arange(len(some))
    if counts.max() > _RUN:
        pieces = -(-counts[some] // _RUN)
        runs = np.concatenate([[0], np.cumsum(pieces)[:-1]])
        cuts = np.repeat(starts, pieces) + _RUN * (np.arange(pieces.sum()) - np.repeat(runs, pieces))
    lanes = np.uint64(0x0001000100010001)
    for w in range(WORDS):
        bits = mix(distinct + np.uint64(w + 1))
        votes = np.empty((len(some), 64), dtype=bool)
        for j in range(16):
            sums = np.add.reduceat((bits >> np.uint64(j)) & lanes, cuts).view(np.uint16).reshape(-1, 4).astype(np.int64)
            votes[:, j::16] = np.add.reduceat(sums, runs, axis=0) * 2 > counts[some, None]
        out[some, w] = np.packbits(votes, axis=1).view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, row_key2, f0..f3) of every document with a text.

    The row keys identify a row by its id and whole text. A text without a word
    gets bits from its exact content; null texts have no row.
    """
    i, t = col(id_col), col(text_col)
    narrow = docs.filter(t.isNotNull()).select(i.alias("doc_id"), F.xxhash64(i, t).alias("row_key"), F.hash(t).alias("row_key2"), F.xxhash64(t).alias("whole"), t.alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in _PARTS]
    out = T.StructType([narrow.schema["doc_id"], narrow.schema["row_key"], narrow.schema["row_key2"], *longs])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, ends = words(part.column(4))
                bits = sketch(hashes, ends)
                bare = np.flatnonzero(np.diff(ends) == 0)
                if len(bare):
                    whole = part.column(3).to_numpy()[bare].view(np.uint64)
                    for w in range(WORDS):
                        bits[bare, w] = mix(whole + np.uint64(w))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(np.ascontiguousarray(bits[:, w]).view(np.int64)) for w in range(WORDS))], names=["doc_id", "row_key", "row_key2", *_PARTS])

    return narrow.mapInArrow(rows, out)


def _coordinates(tables: int) -> np.ndarray:
    """A permutation of all coordinates for each table."""
    return np.stack([np.random.default_rng(1000 + t).permutation(BITS) for t in range(tables)])


def _sample(bits: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    """The named coordinates of each row, packed; coordinates: per row or for all."""
    out = np.zeros(len(bits), dtype=np.int64)
    for c in coordinates.T if coordinates.ndim == 2 else coordinates:
        word = bits[:, c >> 6] if np.ndim(c) == 0 else bits[np.arange(len(bits)), c >> 6]
        out = (out << 1) | ((word >> np.asarray(c & 63, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    return out


def bucket_pairs(buckets: np.ndarray, bits: np.ndarray, radius: int, cap: int, coordinates: np.ndarray, sampled: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within ``radius`` that share a bucket; buckets are sorted."""
    group, place, table = buckets, np.arange(len(buckets)), buckets >> sampled
    low = sampled
    for over in (*_OVER, 0):
        if len(group) < 2:
            return
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        large = np.repeat(sizes > cap, sizes) if over else np.zeros(len(group), dtype=bool)
        yield from _close(group[~large], place[~large], bits, radius)
        if not large.any():
            return
        group, place, table = np.repeat(np.arange(len(sizes)), sizes)[large], place[large], table[large]
        parts = []
        for k in range(over):
            at = low + k * _MORE
            extra = _sample(bits[place], coordinates[table, at : at + _MORE])
            parts.append((group * over + k) << _MORE | extra)
        low += over * _MORE
        group, place, table = np.concatenate(parts), np.tile(place, over), np.tile(table, over)
        by = np.argsort(group, kind="stable")
        group, place, table = group[by], place[by], table[by]


def _close(group: np.ndarray, place: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within ``radius`` in the same group, a lag at a time."""
    if len(group) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    room = np.repeat(starts + sizes, sizes) - np.arange(len(group)) - 1
    own = bits[place]
    alive = np.flatnonzero(room >= 1)
    lag = 1
    while len(alive):
        apart = np.bitwise_count(own[alive] ^ own[alive + lag]).sum(axis=1, dtype=np.int32)
        near = alive[apart <= radius]
        if len(near):
            yield place[near], place[near + lag]
        lag += 1
        alive = alive[room[alive] >= lag]


def _stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each place the least place that pairs connect it with.

    Pairs are taken in lots: memory follows the places, not the pairs.
    """
    label = np.arange(n)

    def join(lot: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = label[np.concatenate([p[0] for p in lot])], label[np.concatenate([p[1] for p in lot])]
        up = np.arange(n)
        while True:
            before = up.copy()
            least = np.minimum(up[a], up[b])
            np.minimum.at(up, a, least)
            np.minimum.at(up, b, least)
            up = up[up]
            if (up == before).all():
                break
        label[:] = up[label]

    lot: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for pair in pairs:
        lot.append(pair)
        held += len(pair[0])
        if held >= _PAIRS:
            join(lot)
            lot, held = [], 0
    if lot:
        join(lot)
    return label


def plan(n: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(tables, sampled): for n fingerprints, so that recall at the radius holds at any size."""
    sampled = max(SAMPLED, math.ceil(math.log2(max(2, n) / PER_BUCKET)))
    # drawn without replacement
    chance = math.prod((BITS - radius - i) / (BITS - i) for i in range(sampled))
    return math.ceil(math.log(1 - recall) / math.log(1 - chance)), sampled


def near_edges(nodes: DataFrame, radius: int, tables: int, sampled: int, cap: int) -> DataFrame:
    """(u, v) of nearby distinct fingerprints; nodes: (node, f0..f3)."""
    coordinates = _coordinates(tables)
    names = ["bucket", "node", *_PARTS]
    kinds = T.StructType([T.StructField("bucket", T.LongType()), *(T.StructField(c, T.LongType()) for c in names[1:])])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(1, 5)], axis=1)
            for t in range(tables):
                bucket = _sample(bits, coordinates[t, :sampled]) | (t << sampled)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[tuple[np.ndarray, ...]], last: bool) -> tuple[pa.RecordBatch | None, list]:
            buckets, ids, bits = (np.concatenate([p[k] for p in parts]) for k in range(3))
            end = len(buckets) if last else int(np.searchsorted(buckets, buckets[-1]))
            label = _stars(end, bucket_pairs(buckets[:end], bits[:end], radius, cap, coordinates, sampled))
            away = np.flatnonzero(label != np.arange(end))
            found = pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[label[away]])], names=["u", "v"])
            return found, [(buckets[end:], ids[end:], bits[end:])] if end < len(buckets) else []

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(2, 6)], axis=1)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))
            if sum(len(h[0]) for h in held) >= 100_000:
                found, held = flush(held, False)
                yield found
        if held:
            yield flush(held, True)[0]

    apart = nodes.mapInArrow(spread, kinds).repartition("bucket").sortWithinPartitions("bucket")
    return apart.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root: the component's least.

    Alternating large and small stars until nothing moves. Each round is written
    to the shared folder, so a lost executor costs no more than a round.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        # large star: larger neighbours go to the least of a node's neighbourhood
        both = now.union(now.select("v", "u"))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the least
        m = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", m).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct()
        after = written(small)
        removed(spark, now)
        now = after
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = mark


def losses(docs: DataFrame, radius: int = RADIUS, tables: int | None = None, sampled: int | None = None, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, row_key2, duplicate_of, copies, stays): rows that lose.

    One row per id and whole text: ``copies`` such rows, of which ``stays`` (0 or
    1) stay. The row of least id stays of each group. ``tables`` and ``sampled``
    follow the number of fingerprints unless they are given.
    """
    marks = written(fingerprints(docs, id_col, text_col))
    node = F.xxhash64(*_PARTS)
    nodes = marks.select(*_PARTS).distinct().select(node.alias("node"), *_PARTS)
    nodes = written(nodes)
    planned = plan(nodes.count(), radius)
    sampled = sampled or planned[1]
    roots = components(near_edges(nodes, radius, tables or planned[0], sampled, cap))
    removed(docs.sparkSession, nodes)
    items = marks.select("doc_id", "row_key", "row_key2", node.alias("node")).join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("grp"), "doc_id", "row_key", "row_key2").agg(F.count("*").alias("copies"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_key").alias("k"), F.col("row_key2").alias("k2"))
    heads = items.groupBy("grp").agg(F.min(rank).alias("head"), F.sum("copies").alias("size")).filter("size > 1")
    found = items.join(heads, "grp")
    stays = (F.col("row_key") == F.col("head.k")) & (F.col("row_key2") == F.col("head.k2"))
    found = found.select("doc_id", "row_key", "row_key2", F.col("head.i").alias("duplicate_of"), "copies", stays.cast("int").alias("stays"))
    return found.filter("copies > stays")


def near_duplicates(docs: DataFrame, **how: object) -> DataFrame:
    """(doc_id, duplicate_of, copies): documents that are near copies of another.

    A group is a connected component of texts within ``radius`` bits; its least
    id is the document that stays, and each other one has a row naming it. Rows
    with the same id and text count as ``copies``; where they include the one
    that stays, the row holds the rest, with ``doc_id`` equal to
    ``duplicate_of``. Null ids come last. A null text is nobody's copy; texts
    without a word are copies only where they are equal. An empty table has no
    groups; other columns are ignored.
    """
    out = losses(docs, **how)
    return out.select("doc_id", "duplicate_of", (F.col("copies") - F.col("stays")).alias("copies"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """docs with one row of each group of near copies, all its columns as they were."""
    lost = losses(docs, id_col=id_col, text_col=text_col, **how)
    key, key2, stays, nth = fresh(docs, "row_key", "row_key2", "stays", "nth")
    i, t = col(id_col), col(text_col)
    keyed = docs.withColumns({key: F.xxhash64(i, t), key2: F.hash(t)})
    lost = lost.select(F.col("row_key").alias(key), F.col("row_key2").alias(key2), F.col("stays").alias(stays))
    joined = keyed.join(lost, [key, key2], "left")
    # a text's copies with the same id: one stays, whichever
    one = Window.partitionBy(key, key2).orderBy(key)
    ranked = joined.filter(col(stays).isNull() | (col(stays) == 1)).withColumn(nth, F.row_number().over(one))
    return ranked.filter(col(stays).isNull() | (col(nth) == 1)).select(*[col(c) for c in docs.columns])

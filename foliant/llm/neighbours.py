"""Approximate nearest neighbours from a forest of random-projection trees.

Each tree splits the vectors at the median along one random direction per level,
orthogonal to those above it. The medians are taken from a bounded sample; every
vector is routed to a leaf of every tree. A query goes through all trees with one
priority queue: it holds the branches not taken yet, by how far the query lies on
the wrong side of their worst split, which bounds the distance to all that is in
them from below. The nearest branch is followed down to a leaf, the ways not taken
join the queue, and so on until ``visits`` leaves are found. Candidates are ranked
by their exact distances.

How many leaves it takes depends on the data's shape and size. Therefore a sample
of queries is compared with the whole table, and the visits are those in which the
queue reaches ``recall`` of their true neighbours.

Vectors are laid out once, by leaf and tree; leaves next to each other in a tree
are a part. A query is sent to the parts of its leaves with a list of them, not
once per leaf, and each part gives its best candidates back. Of equal vectors only
the first k + 1 by id can be anybody's neighbours, so only they are laid out: a
part is bounded by its number of leaves, however many copies a vector has.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.frames import col, removed, written

TREES, LEAF, K = 4, 128, 10
#: Vectors that the trees are fitted on, at most; that a split needs of them; their bytes.
SAMPLE, LEAST, SAMPLE_BYTES = 65_536, 32, 1 << 26
#: Share of true neighbours to find, and queries on which the visits for it are measured.
RECALL, MEASURED = 0.95, 256
#: Vectors of a part, about, as far as leaves allow.
PART = 32_768
_ROWS = 256
Level = np.ndarray


def directions(trees: int, depth: int, dim: int, seed: int) -> np.ndarray:
    """trees x depth unit vectors; within a tree orthogonal as far as they can be."""
    out = np.random.default_rng(seed).normal(size=(trees, depth, dim))
    for t in range(trees):
        for low in range(0, depth, max(dim, 1)):
            part = out[t, low : low + dim]
            out[t, low : low + dim] = np.linalg.qr(part.T)[0].T
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def medians(sample: np.ndarray, planes: np.ndarray) -> list[Level]:
    """Per level trees x nodes: the sample's median there, 0 in a node without any."""
    trees, depth = planes.shape[:2]
    levels, nodes = [], np.zeros((trees, len(sample)), dtype=np.int64)
    along = [sample.astype(np.float64) @ planes[t].T for t in range(trees)]
    for k in range(depth):
        cuts = np.zeros((trees, 1 << k))
        for t in range(trees):
            at = along[t][:, k]
            order = np.lexsort((at, nodes[t]))
            here, first, count = np.unique(nodes[t][order], return_index=True, return_counts=True)
            cuts[t, here] = (at[order[first + (count - 1) // 2]] + at[order[first + count // 2]]) / 2
            nodes[t] = nodes[t] * 2 + (at > cuts[t, nodes[t]])
        levels.append(cuts)
    return levels


def route(x: np.ndarray, planes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """The leaf of each vector, trees x vectors."""
    nodes = np.zeros((len(planes), len(x)), dtype=np.int64)
    for t in range(len(planes)):
        along = x.astype(np.float64) @ planes[t].T
        for k, cuts in enumerate(levels):
            nodes[t] = nodes[t] * 2 + (along[:, k] > cuts[t, nodes[t]])
    return nodes


def search(along: list[list[float]], levels: list[list[list[float]]], visits: int) -> list[int]:
    """The leaves of all trees that one queue gives first; tree t's from t << depth on.

    along: the query's place on each tree's directions; levels: cuts by level and tree.
    """
    depth = len(levels)
    queue: list[tuple[float, int, int, int]] = [(0.0, t, 0, 0) for t in range(len(along))]
    found: list[int] = []
    while queue and len(found) < visits:
        far, t, level, node = heapq.heappop(queue)
        own = along[t]
        for k in range(level, depth):
            gap = own[k] - levels[k][t][node]
            right = gap > 0
            heapq.heappush(queue, (max(far, gap if right else -gap), t, k + 1, 2 * node + (not right)))
            node = 2 * node + right
        found.append((t << depth) + node)
    return found


def places(x: np.ndarray, planes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """How far each vector lies outside each leaf, by its worst split: vectors x leaves."""
    out = []
    for t in range(len(planes)):
        along = x.astype(np.float64) @ planes[t].T
        far = np.zeros((len(x), 1))
        for k, cuts in enumerate(levels):
            gap = along[:, k : k + 1] - cuts[t][None, :]
            far = np.stack([np.maximum(far, gap), np.maximum(far, -gap)], axis=2).reshape(len(x), -1)
        out.append(far)
    return np.concatenate(out, axis=1)


def needed(x: np.ndarray, y: np.ndarray, planes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """The least bound at which each row of x reaches the leaf of its row of y in some tree."""
    worst = np.zeros((len(planes), len(x)))
    for t in range(len(planes)):
        ax, ay = x.astype(np.float64) @ planes[t].T, y.astype(np.float64) @ planes[t].T
        nodes = np.zeros(len(x), dtype=np.int64)
        for k, cuts in enumerate(levels):
            gap, right = ax[:, k] - cuts[t, nodes], ay[:, k] > cuts[t, nodes]
            worst[t] = np.maximum(worst[t], np.where(right, -gap, gap))
            nodes = nodes * 2 + right
    return worst.min(axis=0)


def nearest(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of points, exact distances), queries x up to k + 1, nearest first.

    Points as far as the last one that is kept are kept with it as far as they are
    among 8 more, so that the caller can order equal distances.
    """
    wide = np.float64 if max(np.abs(queries).max(initial=0), np.abs(points).max(initial=0)) > 1e15 else np.float32
    q, p = queries.astype(wide), points.astype(wide)
    take = min(k + 9, len(points))
    near = np.einsum("ij,ij->i", p, p)[None, :] - 2 * (q @ p.T)
    best = np.argpartition(near, take - 1, axis=1)[:, :take] if take < len(points) else np.tile(np.arange(len(points)), (len(q), 1))
    gaps = points[best].astype(np.float64) - queries[:, None, :]
    return best, np.sqrt(np.einsum("qcd,qcd->qc", gaps, gaps))


_ID = ["key", "key2"]


def _compare(batches: Iterator[pa.RecordBatch], dim: int, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Candidates within parts. Rows are sorted by part, a part's points (cell >= 0)
    before the queries that visit it.

    Rows: part, cell, vec_id, key, key2, vector, cells.
    """
    part, held, points = None, [], None

    def answer(asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells, order, ids, x = points
        wanted = asked.column(6)
        lists = wanted.flatten().to_numpy()
        owner = np.repeat(np.arange(asked.num_rows), np.diff(wanted.offsets.to_numpy()))
        q, own, own2 = _matrix(asked.column(5), dim), asked.column(3).to_numpy(), asked.column(4).to_numpy()
        keys, keys2 = ids[1].to_numpy(), ids[2].to_numpy()
        at, other, apart = [], [], []
        by_cell = np.argsort(lists, kind="stable")
        for group in np.split(by_cell, np.flatnonzero(np.diff(lists[by_cell])) + 1):
            if not len(group):
                continue
            low, high = np.searchsorted(cells, [lists[group[0]], lists[group[0]] + 1])
            if low == high:
                continue
            there = order[low:high]
            for k0 in range(0, len(group), _ROWS):
                who = owner[group[k0 : k0 + _ROWS]]
                best, distance = nearest(q[who], x[there], k)
                best = there[best]
                distance[(keys[best] == own[who, None]) & (keys2[best] == own2[who, None])] = np.inf
                at.append(np.repeat(who, best.shape[1]))
                other.append(best.ravel())
                apart.append(distance.ravel())
        if not at:
            return
        at, other, apart = np.concatenate(at), np.concatenate(other), np.concatenate(apart)
        real = np.isfinite(apart)
        at, other, apart = at[real], other[real], apart[real]
        # each query's nearest of the part, once each, with those as far as the last
        by = np.lexsort((other, apart, at))
        at, other, apart = at[by], other[by], apart[by]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (keys[other[1:]] != keys[other[:-1]]) | (keys2[other[1:]] != keys2[other[:-1]])
        at, other, apart = at[new], other[new], apart[new]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, int)
        sizes = np.diff(np.append(first, len(at)))
        last = apart[first + np.minimum(sizes, k) - 1] if len(at) else apart
        keep = apart <= np.repeat(last, sizes)
        at, other, apart = pa.array(at[keep]), pa.array(other[keep]), apart[keep]
        yield pa.RecordBatch.from_arrays([*(asked.column(c).take(at) for c in (2, 3, 4)), *(c.take(other) for c in ids), pa.array(apart)], names=names)

    for batch in batches:
        parts, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | ((cell[1:] < 0) != (cell[:-1] < 0))) + 1).tolist(), len(parts)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if parts[low] != part:
                part, held, points = parts[low], [], None
            rows = batch.slice(low, high - low)
            if cell[low] >= 0:
                held.append(rows)
            elif held:
                if points is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    cells = table.column(1).to_numpy()
                    order = np.argsort(cells, kind="stable")
                    points = cells[order], order, [table.column(c).combine_chunks() for c in (2, 3, 4)], _matrix(table.column(5), dim)
                for k0 in range(0, rows.num_rows, _ROWS):
                    yield from answer(rows.slice(k0, _ROWS))


def _measured(vectors: DataFrame, planes: np.ndarray, levels: list[Level], dim: int, k: int, recall: float, measured: int) -> int:
    """The leaves that the queue has to give for this recall, from a sample of
    queries against all vectors."""
    sample = vectors.orderBy(F.xxhash64("key", "key2"), "key", "key2").limit(measured).select(*_ID, "vector").collect()
    own, own2 = np.array([r["key"] for r in sample]), np.array([r["key2"] for r in sample])
    x = np.array([r["vector"] for r in sample], dtype=np.float32)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(2), dim)
            best, distance = nearest(x, y, k)
            same = (batch.column(0).to_numpy()[best] == own[:, None]) & (batch.column(1).to_numpy()[best] == own2[:, None])
            at, where = np.nonzero(~same)
            need = needed(x[at], y[best[at, where]], planes, levels)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(distance[at, where]), pa.array(need)], names=["at", "distance", "need"])

    near = vectors.select(*_ID, "vector").mapInArrow(compared, "at long, distance double, need double")
    place = F.row_number().over(Window.partitionBy("at").orderBy("distance", "need"))
    best = near.withColumn("place", place).filter(F.col("place") <= k).select("at", "need").collect()
    if not best:
        return len(planes)
    far = np.sort(places(x, planes, levels), axis=1)
    # leaves nearer than a neighbour's come first, and those as near with it
    taken = np.sort([np.searchsorted(far[r["at"]], r["need"] + 1e-12, side="right") for r in best])
    return max(len(planes), int(taken[min(len(taken), math.ceil(recall * len(taken))) - 1]))


def nearest_neighbours(table: DataFrame, k: int = K, queries: DataFrame | None = None, trees: int = TREES, leaf: int = LEAF, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, measured: int = MEASURED, visits: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, neighbour, place, distance): the k nearest rows of each query.

    ``queries`` are rows of the same kind, the table's own if they are not given;
    a query isn't its own neighbour where the table has its id and vector. Distance
    is Euclidean; equal distances are ordered by the neighbour's id. Rows that are
    equal in id and vector count once. A vector that is null, has a null or a value
    that isn't finite, or another length than most of the table's, has no neighbours
    and is none. A null id stays null and comes last. With fewer than k others all
    are given; an empty table gives none; other columns are ignored, whatever their
    names. ``visits`` leaves are visited, by default what a sample of ``measured``
    queries takes for ``recall``. The trees are fitted on ``sample`` rows at most, so
    beyond some 2,000 leaves a tree the leaves grow with the table.
    """
    spark = table.sparkSession

    def clean(rows: DataFrame) -> DataFrame:
        found = rows.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<float>").alias("vector"))
        found = found.filter("size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(v) < float('infinity'))")
        return found.withColumns({"key": F.xxhash64("vec_id", "vector"), "key2": F.hash("vec_id", "vector")})

    found = clean(table)
    lengths = found.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = lengths["dim"] if lengths else 1
    asked = found if queries is None else clean(queries)
    asked = asked.filter(F.size("vector") == dim).dropDuplicates(_ID)
    # of equal vectors the first k + 1
    nth = F.row_number().over(Window.partitionBy(F.xxhash64("vector"), F.hash("vector")).orderBy(F.col("vec_id").asc_nulls_last()))
    rows = written(found.filter(F.size("vector") == dim).dropDuplicates(_ID).withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth"))
    n = rows.count()
    most = max(LEAST, min(sample, SAMPLE_BYTES // (4 * dim)))
    depth = max(0, min(math.ceil(math.log2(max(1, n) / leaf)), math.floor(math.log2(min(n, most) / LEAST)) if n > LEAST else 0))
    planes = directions(trees if depth else 1, depth, dim, seed)
    levels: list[Level] = []
    if depth:
        share = rows if n <= most else rows.filter(F.pmod(F.xxhash64("key2", "key"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
        levels = medians(_matrix(share.select("vector").toArrow().column(0), dim), planes)
        visits = visits or _measured(rows, planes, levels, dim, k, recall, measured)
    count = visits or 1
    # as many leaves to a part as have about PART vectors, next to each other in a tree
    shift = max(0, min(depth, math.floor(math.log2(max(1, PART * (1 << depth) / max(1, n))))))
    plain = [[row.tolist() for row in cuts] for cuts in levels]
    kinds = T.StructType([T.StructField("part", T.LongType()), T.StructField("cell", T.LongType()), *(rows.schema[c] for c in ("vec_id", *_ID, "vector")), T.StructField("cells", T.ArrayType(T.LongType()))])
    fields = kinds.fieldNames()

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = route(_matrix(batch.column(3), dim), planes, levels)
            for t in range(len(planes)):
                cell = cells[t] + (t << depth)
                yield pa.RecordBatch.from_arrays([pa.array(cell >> shift), pa.array(cell), *batch.columns, pa.nulls(batch.num_rows, pa.list_(pa.int64()))], names=fields)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                some = batch.slice(low, _ROWS)
                x = _matrix(some.column(3), dim).astype(np.float64)
                along = [(x @ planes[t].T).tolist() for t in range(len(planes))]
                owner, cells = [], []
                for r in range(some.num_rows):
                    got = sorted(search([a[r] for a in along], plain, count))
                    owner += [r] * len(got)
                    cells += got
                at, cell = np.array(owner, dtype=np.int64), np.array(cells, dtype=np.int64)
                edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (cell[1:] >> shift != cell[:-1] >> shift)])) if len(at) else np.empty(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(at)).astype(np.int32)), pa.array(cell))
                who = pa.array(at[edges])
                yield pa.RecordBatch.from_arrays([pa.array(cell[edges] >> shift), pa.array(np.full(len(edges), -1)), *(c.take(who) for c in some.columns), lists], names=fields)

    here = rows.select("vec_id", *_ID, "vector").mapInArrow(laid, kinds)
    there = asked.select("vec_id", *_ID, "vector").mapInArrow(sent, kinds)
    kind = rows.schema["vec_id"].dataType
    names = ["vec_id", *_ID, "neighbour", "other", "other2", "distance"]
    out = T.StructType([T.StructField("vec_id", kind), rows.schema["key"], rows.schema["key2"], T.StructField("neighbour", kind), T.StructField("other", T.LongType()), T.StructField("other2", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    pairs = here.unionByName(there).repartition("part").sortWithinPartitions("part", F.desc(F.col("cell") >= 0)).mapInArrow(lambda batches: _compare(batches, dim, k, names), out)
    # the same pair from several trees has the same distance
    one = F.struct("distance", F.col("neighbour").isNull().alias("none"), "neighbour", "other", "other2")
    best = pairs.groupBy("vec_id", *_ID).agg(F.slice(F.array_sort(F.collect_set(one)), 1, k).alias("best"))
    result = best.select("vec_id", F.posexplode("best").alias("at", "one")).select("vec_id", F.col("one.neighbour").alias("neighbour"), (F.col("at") + 1).alias("place"), F.col("one.distance").alias("distance"))
    kept = written(result)
    removed(spark, rows)
    return kept

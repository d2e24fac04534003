"""A content-addressed store of token-id streams.

A rolling hash over the last ``SPAN`` ids cuts each document's stream where it
has ``CUT_BITS`` zero bits, so the same passage is cut alike wherever it stands.
A chunk's address is the BLAKE2b hash of its ids' bytes; each distinct chunk is
stored once. A document's recipe lists its chunks' addresses in order, and its
root is the Merkle root over them. The manifest goes on from there: documents are
spread over parts by their keys, each part has the Merkle root over its documents'
roots, and above them each node has the Merkle root over up to ``FAN`` nodes, so no
task holds more than a node's children.

Ids are made and cut in one map over the documents, which leaves out chunks that
the same task has stored already. Then there is one shuffle of chunks by address.
Verification reads back what was stored: each chunk is hashed again, each root is
made again, and each stream is put together again from its chunks. For that a
digest of the whole stream, a polynomial in two prime fields, was stored before it
was cut; the chunks' own digests and lengths compose to it in the recipe's order
exactly if they are the stream, so no ids move.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.bpe import VOCABULARY, vocabulary
from foliant.llm.frames import col, delete, shared_dir, write
from foliant.llm.text import mix, slices

#: Chunks end where the hash of the last SPAN ids has CUT_BITS zero bits, and no
#: such place is among the LEAST before it; MOST ids at the latest.
SPAN, CUT_BITS, LEAST, MOST = 16, 9, 64, 8192
#: Documents of a part, and children of a node above the parts.
PART, FAN = 4096, 4096
_KNOWN = 200_000
_PRIMES = np.array([2147483647, 2147483629], dtype=np.uint64)
_RADIX = np.array([1103515245, 1664525001], dtype=np.uint64)
_BASE = 0xA0761D6478BD642F
#: Ids at once, when digests are made.
_LOT = 1 << 17
_gear: np.ndarray | None = None
_tables = [np.ones((2, 1), dtype=np.uint64)] * 2


def _rolling(ids: np.ndarray) -> np.ndarray:
    """Hashes of the SPAN ids that end at each place, from the SPAN-th on.

    Modulo 2^64 by definition; here their low 16 bits, which depend on no higher ones.
    """
    global _gear
    if _gear is None:
        _gear = mix(np.arange(1 << 16, dtype=np.uint64)).astype(np.uint16)
    total = _gear[ids & 0xFFFF]
    n, factor = 1, _BASE
    while n < SPAN:  # a hash of 2n ids from two of n
        total = total[:-n] * np.uint16(factor & 0xFFFF) + total[n:]
        n, factor = 2 * n, factor * factor % (1 << 64)
    return total


def cut(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end, for streams in a row with n + 1 offsets; ascending.

    A stream's end ends a chunk; what precedes a stream never moves its cuts.
    """
    hits = np.empty(0, dtype=np.int64)
    if len(ids) >= SPAN:
        hits = np.flatnonzero(_rolling(ids) & np.uint16((1 << CUT_BITS) - 1) == 0) + SPAN
        start = ends[np.searchsorted(ends, hits - 1, side="right") - 1]
        hits = hits[hits - start >= SPAN]
        before = np.concatenate([[-1], hits[:-1]])
        start = ends[np.searchsorted(ends, hits - 1, side="right") - 1]
        hits = hits[hits - np.maximum(before, start) >= LEAST]
    stops = np.union1d(hits, ends[1:][np.diff(ends) > 0])
    sizes = np.diff(stops, prepend=0)
    if len(stops) and sizes.max() > MOST:
        extra = [np.arange(s - n + MOST, s, MOST) for s, n in zip(stops[sizes > MOST], sizes[sizes > MOST])]
        stops = np.union1d(stops, np.concatenate(extra))
    return stops


def address(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves in order; a lone node goes up as it is; none: of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=32).digest()
    level = [hashlib.blake2b(b"\x00" + x, digest_size=32).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\x01" + a + b, digest_size=32).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[-1:] if len(level) % 2 else pairs
    return level[0]


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """2 x n powers of the radices or their inverses in their fields, by doubling."""
    if _tables[inverse].shape[1] >= n:
        return _tables[inverse][:, :n]
    out = np.ones((2, n if n > _LOT else _LOT), dtype=np.uint64)
    done = 1
    while done < out.shape[1]:
        more = min(done, out.shape[1] - done)
        step = np.array([[pow(int(r), -done if inverse else done, int(p))] for r, p in zip(_RADIX, _PRIMES)], dtype=np.uint64)
        out[:, done : done + more] = out[:, :more] * step % _PRIMES[:, None]
        done += more
    if n <= _LOT:
        _tables[inverse] = out
    return out[:, :n]


def _power(k: int, exponents: np.ndarray) -> np.ndarray:
    """The k-th radix to each of the exponents, in its field."""
    out, left = _powers(_LOT)[k][exponents % _LOT], exponents // _LOT
    prime = int(_PRIMES[k])
    square = pow(int(_RADIX[k]), _LOT, prime)
    while left.any():
        out = np.where(left & 1 > 0, out * np.uint64(square) % _PRIMES[k], out)
        left, square = left >> 1, square * square % prime
    return out


def digests(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per stream in a row: the sums of (id + 1) r^place in both fields."""
    out = np.zeros((2, len(ends) - 1), dtype=np.uint64)
    low = 0
    while low < len(ends) - 1:  # lots of streams, one at least
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + _LOT, side="right")) - 1)
        start = ends[low:high] - ends[low]
        some = np.flatnonzero(ends[low + 1 : high + 1] > ends[low:high])
        if len(some):
            plus = ids[ends[low] : ends[high]].astype(np.uint64) + np.uint64(1)
            large = int(np.diff(ends[low : high + 1]).max()) * int(plus.max()) >= 1 << 33
            for k, (row, down) in enumerate(zip(_powers(len(plus)), _powers(int(start[some[-1]]) + 1, inverse=True))):
                # places count from the lot's start, which a stream's sum is divided by
                terms = plus * row
                if large:  # the sum would pass 2^64
                    terms %= _PRIMES[k]
                total = np.add.reduceat(terms, start[some]) % _PRIMES[k]
                out[k, low + some] = total * down[start[some]] % _PRIMES[k]
        low = high
    return (out[0] << np.uint64(31) | out[1]).astype(np.int64)


def composed(parts: np.ndarray, sizes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The digests of streams from those of their chunks and the chunks' lengths, in
    order; n + 1 offsets of the streams' chunks, none without."""
    both = parts.astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    before = ends[:-1] - np.repeat(ends[edges[:-1]], np.diff(edges))
    out = []
    for k, d in enumerate((both >> np.uint64(31), both & np.uint64(0x7FFFFFFF))):
        out.append(np.add.reduceat(d * _power(k, before) % _PRIMES[k], edges[:-1]) % _PRIMES[k] if len(parts) else both)
    return (out[0] << np.uint64(31) | out[1]).astype(np.int64)


def _items(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(bytes in a row, n + 1 offsets) of a binary column."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    if not len(wide):
        return memoryview(b""), np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]


def _split(column: pa.Array) -> list[bytes]:
    """The items of a binary column; null counts as empty."""
    data, edges = _items(column)
    every, at = data[int(edges[0]) : int(edges[-1])].tobytes(), (edges - edges[0]).tolist()
    return [every[a:b] for a, b in zip(at[:-1], at[1:])]


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(items in a row, n + 1 offsets) of a list column; null counts as empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _roots(column: pa.Array) -> list[bytes]:
    """Merkle roots over lists of leaves."""
    flat, edges = _lists(column)
    leaves, at = _split(flat), edges.tolist()
    return [merkle(leaves[a:b]) for a, b in zip(at[:-1], at[1:])]


def _recipes(batches: Iterator[pa.RecordBatch], path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path)
    width = np.uint16 if len(bpe.rank_of_id) <= 65536 else np.uint32
    known: set[bytes] = set()
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            texts = part.column(1)
            none = texts.is_null().to_numpy(zero_copy_only=False)
            ids, ends = bpe.encode(texts)
            stops = cut(ids, ends)
            data = ids.astype(width).tobytes()
            item = np.dtype(width).itemsize
            edges = (np.concatenate([[0], stops]) * item).tolist()
            pieces = [data[a:b] for a, b in zip(edges[:-1], edges[1:])]
            addresses = [address(p) for p in pieces]
            edges = np.searchsorted(stops, ends, side="right")
            new: list[bytes | None] = []
            for a, p in zip(addresses, pieces):
                new.append(None if a in known else p)
                known.add(a)
            if len(known) > _KNOWN:
                known.clear()
            low = edges.tolist()
            roots = [merkle(addresses[a:b]) for a, b in zip(low[:-1], low[1:])]
            offsets = pa.array(edges.astype(np.int32))
            recipe = pa.ListArray.from_arrays(offsets, pa.array(addresses, pa.binary()), mask=pa.array(none))
            chunks = pa.ListArray.from_arrays(offsets, pa.array(new, pa.binary()), mask=pa.array(none))
            counts, whole = pa.array(np.diff(ends), mask=none), pa.array(digests(ids, ends), mask=none)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), counts, whole, recipe, chunks, pa.array(roots, pa.binary(), mask=none)], names=names)


def save(docs: DataFrame, base: str, path: str = VOCABULARY, part: int = PART, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write a store below ``base``: tables chunks, recipes and manifest.

    chunks (address, ids) has each distinct chunk once; recipes (doc_id, key, key2,
    n_tokens, digest, recipe, root, part) a row per row of docs; manifest (level,
    idx, documents, root) a row per part at level 0 and per node above, one at the
    top. A null text has a null recipe and root and counts as a document whose root
    is that of nothing; an empty one has an empty recipe and the root of nothing.
    Repeated rows repeat recipes only, and count in a part's leaf. A null id stays
    null; other columns are ignored; an empty table makes empty tables. Long texts
    make long recipes, one chunk of at most ``MOST`` ids each.
    """
    spark = docs.sparkSession
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(id_col), col(text_col)).alias("key"), F.hash(col(id_col), col(text_col)).alias("key2"))
    kinds = T.StructType([narrow.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("key2", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("recipe", T.ArrayType(T.BinaryType())), T.StructField("chunks", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType())])
    names = kinds.fieldNames()
    raw = f"{base}/raw"
    write(narrow.mapInArrow(lambda batches: _recipes(batches, path, names), kinds), raw, "zstd")
    made = spark.read.schema(kinds).parquet(raw)
    pairs = made.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("c")).select(F.col("c.recipe").alias("address"), F.col("c.chunks").alias("ids")).filter("ids is not null")
    write(pairs.repartition("address").dropDuplicates(["address"]), f"{base}/chunks", "zstd")
    parts = max(1, math.ceil(made.count() / part))
    recipes = made.select("doc_id", "key", "key2", "n_tokens", "digest", "recipe", "root", F.pmod(F.xxhash64("key", "key2"), F.lit(parts)).alias("part"))
    write(recipes, f"{base}/recipes", "zstd")
    delete(spark, raw)
    levels = 0
    while parts > 1:
        parts, levels = math.ceil(parts / fan), levels + 1
    write(manifest_of(spark.read.parquet(f"{base}/recipes"), levels, fan), f"{base}/manifest")


def _joined(groups: DataFrame) -> DataFrame:
    """(idx, documents, root) from (idx, documents, leaves): Merkle roots over sorted leaves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_roots(batch.column(2)), pa.binary())], names=["idx", "documents", "root"])

    return groups.mapInArrow(rows, "idx long, documents long, root binary")


def manifest_of(recipes: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """(level, idx, documents, root): parts at level 0, up to one node at the top."""
    none = F.coalesce("root", F.lit(merkle([])))
    # copies of a row are one leaf with their number
    rows = recipes.groupBy("part", "key", "key2", none.alias("root")).agg(F.count("*").alias("n"))
    leaf = F.concat(F.unhex(F.lpad(F.hex("key"), 16, "0")), F.unhex(F.lpad(F.hex("key2"), 16, "0")), F.unhex(F.lpad(F.hex("n"), 16, "0")), F.col("root"))
    now = _joined(rows.groupBy(F.col("part").alias("idx")).agg(F.sum("n").alias("documents"), F.array_sort(F.collect_list(leaf)).alias("leaves")))
    out = now.withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        leaf = F.concat(F.unhex(F.lpad(F.hex("idx"), 16, "0")), F.col("root"))
        now = _joined(now.groupBy(F.floor(F.col("idx") / fan).alias("idx")).agg(F.sum("documents").alias("documents"), F.array_sort(F.collect_list(leaf)).alias("leaves")))
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out.select("level", "idx", "documents", "root")


def verify(spark: SparkSession, base: str, path: str = VOCABULARY, fan: int = FAN) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, part, root, verified) from what is stored.

    ``verified`` says that every chunk of the recipe is there and hashes to its
    address, that the chunks in order are the stream of which the digest and the
    length were stored, that the recipe gives the root, and that the document's
    part and all nodes above have the roots of the manifest. It is null with a
    null recipe. A part that fails is told from the others, a damaged node above
    concerns all below it.
    """
    recipes, chunks, manifest = (spark.read.parquet(f"{base}/{name}") for name in ("recipes", "chunks", "manifest"))
    width = np.uint16 if len(vocabulary(path).rank_of_id) <= 65536 else np.uint32

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = np.dtype(width).itemsize
        for batch in batches:
            data, edges = _items(batch.column(1))
            at = edges.tolist()
            named = pa.array([address(data[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())
            sound = pc.fill_null(pc.equal(batch.column(0).cast(pa.binary()), named), False)
            held, column = batch.column(0).filter(sound), batch.column(1).filter(sound)
            data, edges = _items(column)
            sizes = np.diff(edges) // item
            ids = np.frombuffer(data[int(edges[0]) : int(edges[-1])], dtype=width)
            yield pa.RecordBatch.from_arrays([held, pa.array(sizes), pa.array(digests(ids, np.concatenate([[0], np.cumsum(sizes)])))], names=["address", "n", "part_digest"])

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, digest = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            found, edges = _lists(batch.column(4))
            here = found.field("n").is_valid().to_numpy(zero_copy_only=False)
            sizes, parts = (pc.fill_null(found.field(name), 0).to_numpy() for name in ("n", "part_digest"))
            whole = np.logical_and.reduceat(here, edges[:-1]) & (np.add.reduceat(sizes, edges[:-1]) == n)
            held = whole & (composed(parts, sizes, edges) == digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held)], names=["key", "key2", "rebuilt"])

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipe, root = batch.column("recipe"), batch.column("root")
            fits = pc.fill_null(pc.equal(root.cast(pa.binary()), pa.array(_roots(recipe), pa.binary())), False)
            same = pc.if_else(recipe.is_valid(), fits, None)
            yield pa.RecordBatch.from_arrays([*batch.columns, same], names=[*batch.schema.names, "same"])

    sound = chunks.select("address", "ids").mapInArrow(again, "address binary, n long, part_digest long")
    once = recipes.filter("size(recipe) > 0").dropDuplicates(["key", "key2"]).select("key", "key2", "n_tokens", "digest", F.posexplode("recipe").alias("pos", "address"))
    placed = once.join(sound, "address", "left").groupBy("key", "key2", "n_tokens", "digest").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "part_digest"))).alias("found"))
    streams = placed.mapInArrow(rebuilt, "key long, key2 int, rebuilt boolean")
    checked = recipes.mapInArrow(rooted, T.StructType([*recipes.schema.fields, T.StructField("same", T.BooleanType())])).select("doc_id", "key", "key2", "n_tokens", "recipe", "root", "part", "same")
    levels = manifest.agg(F.max("level")).first()[0] or 0
    now = manifest_of(recipes, levels, fan).alias("now").join(manifest.alias("then"), ["level", "idx"], "left")
    held = now.select("level", "idx", F.coalesce(F.col("now.root") == F.col("then.root"), F.lit(False)).alias("held"))
    fine = held.filter("level = 0").select("idx", "held", F.col("idx").alias("part"))
    above = held.filter("level > 0").select("level", F.col("idx").alias("up"), F.col("held").alias("up_held"))
    for level in range(1, levels + 1):
        step = above.filter(F.col("level") == level).select("up", "up_held")
        fine = fine.withColumn("up", F.floor(F.col("idx") / fan)).join(step, "up", "left").select(F.col("up").alias("idx"), (F.col("held") & F.coalesce("up_held", F.lit(False))).alias("held"), "part")
    joined = checked.join(streams, ["key", "key2"], "left").join(fine.select("part", "held"), "part", "left")
    sure = F.col("same") & (F.coalesce("rebuilt", F.lit(False)) | ((F.size("recipe") == 0) & (F.col("n_tokens") == 0))) & F.coalesce("held", F.lit(False))
    return joined.select("doc_id", "n_tokens", F.when(F.col("recipe").isNotNull(), F.size("recipe")).alias("n_chunks"), "part", F.lower(F.hex("root")).alias("root"), F.when(F.col("same").isNotNull(), sure).alias("verified"))


def restore(spark: SparkSession, base: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the streams of a store, a row per recipe; null stays null."""
    recipes, chunks = spark.read.parquet(f"{base}/recipes"), spark.read.parquet(f"{base}/chunks")
    width = np.uint16 if len(vocabulary(path).rank_of_id) <= 65536 else np.uint32
    keyed = recipes.dropDuplicates(["key", "key2"])
    placed = keyed.select("key", "key2", F.posexplode("recipe").alias("pos", "address")).join(chunks.select("address", "ids"), "address")
    grouped = placed.groupBy("key", "key2").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("all")).select("key", "key2", F.col("all.ids").alias("pieces"))
    kind = recipes.schema["doc_id"]
    out = T.StructType([kind, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [None if n is None else np.frombuffer(b"".join(p or []), dtype=width).astype(np.int32) for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return recipes.join(grouped, ["key", "key2"], "left").select("doc_id", "n_tokens", "pieces").mapInArrow(glued, out)


def store_and_verify(docs: DataFrame, **how: object) -> DataFrame:
    """A store of docs in the shared folder, and what verify() finds in it."""
    base = shared_dir(docs.sparkSession)
    save(docs, base, **how)
    return verify(docs.sparkSession, base, **{k: v for k, v in how.items() if k in ("path", "fan")})

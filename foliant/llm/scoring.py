"""Stupid-backoff scores of documents under the corpus' n-gram counts.

The texts scored are the corpus itself, so each word is held out in turn: it is
scored by the counts of all other occurrences. A word after ``order`` - 1 others
scores how often else the n-gram occurs over how often else those others occur as
a context, if the n-gram occurs elsewhere at all; else ``alpha`` times what it
scores after one word less. After none it scores its share of all other words,
as if it occurred once where it doesn't. What precedes the first word are starts of
text, as many as are needed. A document's score is the sum of its words' logarithms.

Above pairs, the occurrences of each order are shuffled by their context, counted
and scored. What isn't scored goes on to the next lower order as it is, what is
scored as n-grams with their numbers, as both count there. Contexts that are too
common for a bucket are counted beforehand and spread by the word after them.

The count tables are partitioned by hash. Pairs are exploded once and shuffled by
the hash of the first word, so the pair counts and the context counts of a
partition are made from what it holds, and joined to it, in one place. The
commonest ``HOT`` words, whose counts travel with the task, are spread by both
words. What backs off to a word that isn't common is shuffled again, by the word,
and meets the word counts there. Last, partial sums are added up per document.

All counts above single words that an n-gram needs, whatever the order, are of
n-grams with the same word before the last. So the work is done in ``PASSES``
rounds, each for its share of those words, by a hash, and each writes its partial
sums: only a round's n-grams are ever on disk. Half of the texts are parsed once, and
their words written by number, which the rounds read.

Exploded n-grams travel as packed columns of a batch, a row per bucket of the hash
and batch of texts, so a shuffled pair takes some ten bytes. A bucket has about
``PER_BUCKET`` n-grams whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.frames import col, removed, written
from foliant.llm.text import mix, slices, words

ALPHA = 0.4
#: Words of the longest n-grams, and rounds over the texts.
ORDER, PASSES = 3, 8
#: Words whose counts are broadcast, and pairs per bucket: both bound memory, neither the result.
HOT, PER_BUCKET = 1 << 16, 1 << 20
_START = np.uint64(0x5374617274206F66)
_SLICE = 4 << 20
_FLUSH = 1_000_000
_PACKED = "bucket long, kind int, docs binary, sizes binary, words binary, first binary, second binary"
_NAMES = ["bucket", "kind", "docs", "sizes", "words", "first", "second"]
_PENDING, _SUMS, _COUNTS, _SCORED = 0, 1, 2, 3


def _small(x: np.ndarray) -> bytes:
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
    return _zip(bytes([np.dtype(kind).itemsize]), x.astype(kind))


def _large(data: bytes) -> np.ndarray:
    width = data[0]
    return _unzip(data[1:], width).view({1: np.uint8, 2: np.uint16, 4: np.uint32}[width]).astype(np.int64)


def _zip(head: bytes, x: np.ndarray) -> bytes:
    """Compressed, all first bytes of the numbers before all second ones."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else x
    return head + x.nbytes.to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unzip(data: bytes, width: int) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    flat = np.frombuffer(pa.decompress(data[4:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).ravel()


def _ascending(x: np.ndarray) -> bytes:
    """Numbers of 64 bits in ascending order, as their differences."""
    return _zip(b"", np.diff(x.view(np.uint64), prepend=np.uint64(0)))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data, 8).view(np.uint64), dtype=np.uint64)


def pack(bucket: int, docs: np.ndarray, columns: list[np.ndarray], scored: bool = False) -> tuple:
    """One row: runs of documents, which ascend, and columns of words by number.

    With ``scored``, numbers of occurrences take the place of documents.
    """
    distinct, back = np.unique(np.concatenate(columns), return_inverse=True)
    last = len(docs) * (len(columns) - 1)
    words = (_ascending(distinct), _small(back[:last]), _small(back[last:])) if last else (_ascending(distinct), _small(back), None)
    if scored:
        return bucket, _SCORED, None, _small(docs), *words
    new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return bucket, _PENDING, _ascending(docs[new]), _small(np.diff(np.append(new, len(docs)))), *words


def unpack(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    docs = np.repeat(_summed(row["docs"]), _large(row["sizes"])) if row["kind"] == _PENDING else _large(row["sizes"])
    distinct = _summed(row["words"])
    first = distinct[_large(row["first"])]
    return docs, [first] if row["second"] is None else [*np.split(first, len(first) // len(docs)), distinct[_large(row["second"])]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=_NAMES)


def scatter(buckets: np.ndarray, docs: np.ndarray, columns: list[np.ndarray], scored: bool = False) -> Iterator[pa.RecordBatch]:
    """Packed rows, one per bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    buckets, docs, columns = buckets[order], docs[order], [c[order] for c in columns]
    edges = np.append(np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])), len(buckets)) if len(buckets) else [0]
    rows: list[tuple] = []
    for low, high in zip(edges[:-1], edges[1:]):
        rows.append(pack(int(buckets[low]), docs[low:high], [c[low:high] for c in columns], scored))
        if len(rows) >= 64:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def chain(hashes: np.ndarray, rows: np.ndarray, start: int = _START) -> tuple[np.ndarray, np.ndarray]:
    """(word before each word, row of each word); the start before the first."""
    before = np.concatenate([[start], hashes[:-1]]) if len(hashes) else hashes
    sizes = np.diff(rows)
    before[rows[:-1][sizes > 0]] = start
    return before, np.repeat(np.arange(len(sizes)), sizes)


def history(hashes: np.ndarray, rows: np.ndarray, order: int, start: int = _START) -> tuple[list[np.ndarray], np.ndarray]:
    """(the n-gram that ends with each word, as columns; row of each word)."""
    before, row = chain(hashes, rows, start)
    columns = [before, hashes]
    starts = rows[:-1][np.diff(rows) > 0]
    for _ in range(order - 2):
        before = np.concatenate([[start], before[:-1]]) if len(before) else before
        before[starts] = start
        columns.insert(0, before)
    return columns, row


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """One number for the words of a context."""
    out = columns[0]
    for c in columns[1:]:
        out = mix(mix(out) + c)
    return out


class Common:
    """Counts of the commonest words, and where their rows go."""

    def __init__(self, word: np.ndarray, seen: np.ndarray, context: np.ndarray, buckets: int) -> None:
        order = np.argsort(word)
        self.word, self.seen, self.context, self.buckets = word[order], seen[order], context[order], np.uint64(buckets)

    def place(self, words: np.ndarray) -> np.ndarray:
        """The number of each common word, -1 for others."""
        if not len(self.word):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.word, words), len(self.word) - 1)
        return np.where(self.word[at] == words, at, -1)

    def of_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (mix(np.where(self.place(first) >= 0, first ^ mix(second), first)) % self.buckets).astype(np.int64)

    @staticmethod
    def round_of(words: np.ndarray, passes: int) -> np.ndarray:
        """In which round n-grams with this word before the last are counted."""
        return (mix(words + _START) >> np.uint64(32)) % np.uint64(passes)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        return (mix(words ^ _START) % self.buckets).astype(np.int64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of slices of texts (key, text), by number, with their keys and how many words each has."""
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            hashes, rows = words(part.column(1))
            if len(hashes):
                distinct, back = np.unique(hashes, return_inverse=True)
                packed = _zip(b"", part.column(0).to_numpy()), _small(np.diff(rows)), _ascending(distinct), _small(back)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names=["docs", "sizes", "words", "first"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, offsets of their words, words by number, distinct words, the start last) of each slice."""
    for batch in batches:
        for k in range(batch.num_rows):
            docs, sizes, distinct, first = (batch.column(n)[k].as_py() for n in ("docs", "sizes", "words", "first"))
            rows = np.concatenate([[0], np.cumsum(_large(sizes))])
            yield _unzip(docs, 8).view(np.uint64), rows, _large(first), np.append(_summed(distinct), _START)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What _parsed() gives, of texts (key, text) themselves; each word has a number of its own."""
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            hashes, rows = words(part.column(1))
            yield part.column(0).to_numpy().view(np.uint64), rows, np.arange(len(hashes)), np.append(hashes, _START)


_Cut = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def _tally(batches: Iterator[pa.RecordBatch], cut: _Cut) -> Iterator[pa.RecordBatch]:
    for _, rows, number, distinct in cut(batches):
        if cut is _cut:
            distinct, number = np.unique(distinct[:-1], return_inverse=True)
            distinct = np.append(distinct, _START)
        before, _ = chain(number, rows, len(distinct) - 1)
        seen, context = (np.bincount(x, minlength=len(distinct)) for x in (number, before))
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(seen), pa.array(context)], names=["word", "seen", "context"])


class _Sums:
    """Partial sums per document, merged when they are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, docs: np.ndarray, tokens: np.ndarray | None, score: np.ndarray) -> None:
        distinct, back = np.unique(docs, return_inverse=True)
        tokens = np.bincount(back, minlength=len(distinct)) if tokens is None else np.bincount(back, tokens, len(distinct)).astype(np.int64)
        self.parts.append((distinct, tokens, np.bincount(back, score, len(distinct))))
        self.held += len(distinct)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, self.parts, self.held = self.parts, [], 0
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)
        whole = _Sums()
        whole.add(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        return whole.parts[0]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if held:
                    yield now, held
                now, held = row["bucket"], []
            held.append(row)
    if held:
        yield now, held


def _share(seen: np.ndarray, total: int) -> np.ndarray:
    """Logarithms of words' shares of all other words."""
    return np.log(np.maximum(seen - 1, 1) / max(total - 1, 1))


def _count(batches: Iterator[pa.RecordBatch], common: Common, words: Common, total: int, alpha: float, skipped: int, below: Common | None) -> Iterator[pa.RecordBatch]:
    """Count a bucket's n-grams and contexts; score what is known there.

    common: of the contexts; words: of single words; skipped: longer orders before
    this one; below: of the contexts of the next lower order, None for pairs.
    """
    sums, wait, waiting = _Sums(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal wait, waiting
        if wait:
            docs = np.concatenate([w[0] for w in wait])
            columns = [np.concatenate(c) for c in zip(*(w[1] for w in wait))]
            order = np.argsort(docs, kind="stable")
            columns = [c[order] for c in columns]
            yield from scatter(words.of_words(columns[0]) if below is None else below.of_pairs(folded(columns[:-1]), columns[-1]), docs[order], columns)
        wait, waiting = [], 0

    def known() -> Iterator[pa.RecordBatch]:
        docs, tokens, score = sums.take()
        for low in range(0, len(docs), 50_000):
            cut = slice(low, low + 50_000)
            bucket = int(mix(docs[cut][:1])[0] % common.buckets)
            yield _batch([(bucket, _SUMS, _ascending(docs[cut]), _small(tokens[cut]), score[cut].tobytes(), None, None)])

    for _, rows in _groups(batches):
        for r in rows:
            if r["kind"] == _SUMS:
                yield _batch([tuple(r[n] for n in _NAMES)])
        rows = [r for r in rows if r["kind"] != _SUMS]
        if not rows:
            continue
        opened = [unpack(r) for r in rows]
        asked = np.repeat([r["kind"] == _PENDING for r in rows], [len(o[0]) for o in opened])
        docs = np.concatenate([o[0].view(np.uint64) for o in opened])
        columns = [np.concatenate(c) for c in zip(*(o[1] for o in opened))]
        del opened
        weight = np.where(asked, 1, docs.view(np.int64))
        first, second = folded(columns[:-1]), columns[-1]
        _, back = np.unique(mix(mix(first) + second), return_inverse=True)
        count = np.bincount(back, weight)[back]
        place = common.place(first)
        _, back = np.unique(first, return_inverse=True)
        context = np.bincount(back, weight)[back]
        if len(common.word):
            context = np.where(place >= 0, common.context[place], context)
        kept = asked & (count > 1)
        score = np.zeros(len(docs))
        score[kept] = np.log((count[kept] - 1) / (context[kept] - 1)) + skipped * math.log(alpha)
        if below is None:
            own = words.place(second)
            back_off = np.flatnonzero(asked & ~kept & (own >= 0))
            score[back_off] = _share(words.seen[own[back_off]], total) + (skipped + 1) * math.log(alpha)
            sums.add(docs[asked], None, score[asked])
            rest = asked & ~kept & (own < 0)
            wait.append((docs[rest], [second[rest]]))
        else:
            sums.add(docs[kept], None, score[kept])
            rest = asked & ~kept
            wait.append((docs[rest], [c[rest] for c in columns[1:]]))
            lower, weight = [c[~rest] for c in columns[1:]], weight[~rest]
            if len(weight):
                _, one, back = np.unique(mix(mix(folded(lower[:-1])) + lower[-1]), return_index=True, return_inverse=True)
                lower = [c[one] for c in lower]
                yield from scatter(below.of_pairs(folded(lower[:-1]), lower[-1]), np.bincount(back, weight).astype(np.int64), lower, True)
        waiting += int(rest.sum())
        if waiting >= _FLUSH:
            yield from flush()
        if sums.held >= _FLUSH:
            yield from known()
    yield from flush()
    yield from known()


def _resolve(batches: Iterator[pa.RecordBatch], total: int, alpha: float, backed: int) -> Iterator[pa.RecordBatch]:
    """Join what backed off to the word counts of its bucket; hand sums on."""
    sums = _Sums()

    def out() -> pa.RecordBatch:
        docs, tokens, score = sums.take()
        return pa.RecordBatch.from_arrays([pa.array(docs.view(np.int64)), pa.array(tokens), pa.array(score)], names=["doc", "tokens", "score"])

    for _, rows in _groups(batches):
        word, seen = np.empty(0, np.uint64), np.empty(0, np.int64)
        counts = [r for r in rows if r["kind"] == _COUNTS]
        if counts:
            word = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in counts])
            seen = np.concatenate([_large(r["first"]) for r in counts])
            order = np.argsort(word)
            word, seen = word[order], seen[order]
        for r in rows:
            if r["kind"] == _SUMS:
                sums.add(_summed(r["docs"]), _large(r["sizes"]), np.frombuffer(r["words"], np.float64))
            elif r["kind"] == _PENDING:
                docs, (second,) = unpack(r)
                sums.add(docs, np.zeros(len(docs)), _share(seen[np.searchsorted(word, second)], total) + backed * math.log(alpha))
        if sums.held >= _FLUSH:
            yield out()
    yield out()


def score_documents(docs: DataFrame, alpha: float = ALPHA, hot: int = HOT, per_bucket: int = PER_BUCKET, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, passes: int = PASSES) -> DataFrame:
    """(doc_id, copies, n_tokens, log_score, mean_log_score), a row per document.

    Words are runs of letters, digits and underscores in lower case. Rows equal
    in id and text are one row with ``copies`` of them, though all of them count
    in the corpus; ``n_tokens`` and ``log_score`` are of one copy. A text that is
    null, empty or without a word has no words and null scores. A null id stays
    null; other columns are ignored, whatever their names; an empty table gives
    none. Long texts are worked on whole: a batch holds one at least. ``order``, 2
    or more, is the words of the longest n-grams. Documents are told apart by 64
    bits of a hash of id and text: of 3e10 some 25 pairs would share their sums.
    """
    if order < 2 or passes < 1:
        raise ValueError("order is 2 or more, passes 1 or more")
    key = F.xxhash64(col(id_col), col(text_col))
    texts = docs.filter(col(text_col).isNotNull()).select(key.alias("key"), col(text_col).alias("text"))
    # words of every other text are kept, the rest are cut anew each time: all of them would take too much disk, none too long
    half = F.col("key").bitwiseAND(1) == 0
    parsed = written(texts.filter(half).mapInArrow(_parse, "docs binary, sizes binary, words binary, first binary"), "uncompressed")
    rest = texts.filter(~half)

    def of_all(work: Callable[[Iterator[pa.RecordBatch], _Cut], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        made = [frame.mapInArrow(lambda batches, cut=cut: work(batches, cut), schema) for frame, cut in ((parsed, _parsed), (rest, _cut))]
        return made[0].unionByName(made[1])

    counts = written(of_all(_tally, "word long, seen long, context long").groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("context").alias("context")))
    total = int(counts.agg(F.sum("seen")).first()[0] or 0)
    buckets = max(1, math.ceil(total / per_bucket / passes))
    top = counts.orderBy(F.desc(F.greatest("seen", "context")), "word").limit(hot).toPandas()
    common = Common(top["word"].to_numpy(np.int64).view(np.uint64), top["seen"].to_numpy(np.int64), top["context"].to_numpy(np.int64), buckets)
    often = max(1, per_bucket // 4)
    heavy = np.sort(common.word[np.maximum(common.seen, common.context) >= often])

    def contexts(k: int) -> Common:
        """Contexts of k - 1 words that are too common for one bucket: all their words are."""

        def count(batches: Iterator[pa.RecordBatch], cut: _Cut) -> Iterator[pa.RecordBatch]:
            for _, rows, number, distinct in cut(batches):
                columns = history(number, rows, k, len(distinct) - 1)[0][:-1]
                common = np.isin(distinct, heavy)
                whole = np.all([common[c] for c in columns], axis=0)
                found, times = np.unique(folded([distinct[c[whole]] for c in columns]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["context", "times"])

        none = np.empty(0, np.int64)
        if not len(heavy):
            return Common(none.view(np.uint64), none, none, buckets)
        found = of_all(count, "context long, times long").groupBy("context").agg(F.sum("times").alias("times")).filter(F.col("times") >= often).toPandas()
        times = found["times"].to_numpy(np.int64)
        return Common(found["context"].to_numpy(np.int64).view(np.uint64), times, times, buckets)

    by_order = {2: common} | {k: contexts(k) for k in range(3, order + 1)}

    def explode(batches: Iterator[pa.RecordBatch], cut: _Cut, turn: int) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, list[np.ndarray]]] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            # texts are gathered until a bucket's share of them packs well
            nonlocal wait, waiting
            if wait:
                keys = np.concatenate([w[0] for w in wait])
                at = np.argsort(keys, kind="stable")
                columns = [np.concatenate(c)[at] for c in zip(*(w[1] for w in wait))]
                wait, waiting = [], 0
                yield from scatter(by_order[order].of_pairs(folded(columns[:-1]), columns[-1]), keys[at], columns)

        for keys, rows, number, distinct in cut(batches):
            columns, row = history(number, rows, order, len(distinct) - 1)
            now = np.flatnonzero((Common.round_of(distinct, passes) == turn)[columns[-2]])
            wait.append((keys[row[now]], [distinct[c[now]] for c in columns]))
            waiting += len(now)
            if waiting >= _FLUSH:
                yield from flush()
        yield from flush()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, seen = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            rare = common.place(word) < 0
            word, seen = word[rare], seen[rare]
            bucket = common.of_words(word)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else np.empty(0, int)
            rows = [(int(bucket[p[0]]), _COUNTS, None, None, word[p].tobytes(), _small(seen[p]), None) for p in np.split(order, edges[1:]) if len(p)]
            if rows:
                yield _batch(rows)

    def counted_at(k: int, rows: DataFrame) -> DataFrame:
        below = by_order.get(k - 1)
        return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _count(batches, by_order[k], common, total, alpha, order - k, below), _PACKED)

    words_by = counts.select("word", "seen").mapInArrow(listed, _PACKED)
    parts = []
    for turn in range(passes):
        counted = of_all(lambda batches, cut, turn=turn: explode(batches, cut, turn), _PACKED)
        for k in range(order, 1, -1):
            counted = counted_at(k, counted)
        sums = counted.unionByName(words_by).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _resolve(batches, total, alpha, order - 1), "doc long, tokens long, score double")
        parts.append(written(sums.groupBy("doc").agg(F.sum("tokens").alias("tokens"), F.sum("score").alias("score"))))
    removed(docs.sparkSession, counts, parsed)
    sums = reduce(DataFrame.unionByName, parts).groupBy("doc").agg(F.sum("tokens").alias("tokens"), F.sum("score").alias("score"))
    base = docs.groupBy(key.alias("doc"), col(id_col).alias("doc_id")).agg(F.count("*").alias("copies"))
    score = F.round(F.col("score") / F.col("copies"), 6)
    return base.join(sums, "doc", "left").select("doc_id", "copies", F.coalesce((F.col("tokens") / F.col("copies")).cast("long"), F.lit(0)).alias("n_tokens"), score.alias("log_score"), F.round(F.col("score") / F.col("tokens"), 6).alias("mean_log_score"))

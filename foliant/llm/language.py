"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a bounded amount
of labelled text. A text is parsed against it greedily into longest matches; the
fewer phrases per letter it takes, the lower its cross-entropy with that
language, and the language that needs fewest wins. A text that needs more than
``reject`` phrases a letter in the best language has none: it is in another
language or in none. Its last phrase, which the text's end cuts off, doesn't count
for that.

Samples differ in size, and a longer one gives longer matches: a language's rates
are compared in proportion to the logarithm of its sample's letters, by which
phrases grow. Languages with next to no sample are left out, see ``LEAST_LETTERS``.

The automata are small and travel with the task. Texts are cut into blocks that
are parsed in lockstep, one gather per letter and language for thousands of
blocks at once. Each block is first parsed as if a phrase began with it; then the
state that the block before ended in is carried into it until both parses are in
one state, after which they agree. So the phrases are those of the whole text.
Map only: one scan, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.frames import col, fresh, without
from foliant.llm.text import codepoints, fold_table, kept, slices

#: The labelled sample: rows drawn at a time and letters kept, per language.
SAMPLE_ROWS, SAMPLE_LETTERS = 64, 24_000
#: A language with fewer letters than this is left out, as its texts can't be told
#: from others; where no language has four times as many, a quarter of the largest.
LEAST_LETTERS = 500
#: Letters that are parsed at once; without any effect on the result.
BLOCK = 512
REJECT = 0.42
_PAD, _SPACE, _UNKNOWN = 0, 1, 2
#: Letters that have a class each; rarer ones are spelled in so many digits of this base.
_SINGLE, _RADIX, _DIGITS = 92, 32, 4


def alphabet(texts: list[str]) -> np.ndarray:
    """Code point -> class: the samples' commonest letters, one each; a space for
    digits and all that is no letter; letters that no sample has together, as none
    can match them. The samples' other letters are to be spelled: -1."""
    fold = fold_table()
    numeric = np.zeros(0x110000, dtype=bool)
    numeric[[k for k in np.flatnonzero(fold) if not chr(int(k)).isalpha()]] = True
    counts: dict[int, int] = {}
    for text in texts:
        points = fold[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        for c, n in zip(*np.unique(points[(points != 0) & ~numeric[points]], return_counts=True)):
            counts[int(c)] = counts.get(int(c), 0) + int(n)
    own = np.full(0x110000, _UNKNOWN, dtype=np.int16)
    ranked = sorted(counts, key=lambda c: (-counts[c], c))
    for k, c in enumerate(ranked):
        own[c] = k + 3 if k < _SINGLE else -1
    out = own[fold]
    out[(fold == 0) | numeric] = _SPACE
    return out


def squeeze(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places that stay, their offsets): runs of what is no letter become one
    space, and none is at the start of a text."""
    keep = classes != _SPACE
    keep[1:] |= classes[:-1] != _SPACE
    inner = ends[:-1][ends[:-1] < len(classes)]
    keep[inner] = classes[inner] != _SPACE
    total = np.concatenate([[0], np.cumsum(keep)])
    return np.flatnonzero(keep), total[ends]


def spelled(classes: np.ndarray, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): a symbol for each class, ``_DIGITS`` for a letter that has none."""
    rare = np.flatnonzero(classes < 0)
    if not len(rare):
        return classes.astype(np.uint8), ends
    wide = np.ones(len(classes), dtype=np.int64)
    wide[rare] = _DIGITS
    starts = np.cumsum(wide) - wide
    out = np.repeat(np.maximum(classes, 0), wide).astype(np.uint8)
    letters = fold_table()[points[rare]]
    for d in range(_DIGITS):
        out[starts[rare] + d] = 3 + _SINGLE + (letters // _RADIX**d) % _RADIX
    return out, np.append(starts, len(out))[ends]


def automaton(letters: np.ndarray, width: int) -> np.ndarray:
    """Suffix automaton of a text, as a table: row + symbol -> next row | miss.

    Row numbers are multiples of ``width``, a power of two; the low bit says that the
    match ended and a new phrase began with this letter. Padding never ends one.
    """
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in letters.tolist():
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    # state 0 is the start; one more stands before a text and after a letter that
    # never occurs: whatever comes there begins a phrase
    lost = len(follow)
    first = np.full(width, lost, dtype=np.int32)
    for c, s in follow[0].items():
        first[c] = s
    table = np.tile(first * width | 1, (lost + 1, 1))
    for s in range(1, lost):
        for c, to in follow[s].items():
            table[s, c] = to * width
    table[:, _PAD] = np.arange(lost + 1) * width
    return table.ravel()


def phrases(columns: np.ndarray, first: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """How many phrases begin in each block.

    columns: step x block, padded; first: whether a block begins a text. Blocks of
    a text follow each other.
    """
    steps, n = columns.shape
    lost = np.int32(len(table) - width)
    alone = np.empty((steps, n), dtype=np.int32)  # states of blocks parsed by themselves
    row, begun = np.full(n, lost), np.zeros(n, dtype=np.int32)
    for k in range(steps):
        np.take(table, row | columns[k], out=alone[k], mode="clip")  # row numbers leave the low bits free
        begun += alone[k] & 1
        row = alone[k] & ~1
    by_itself, ended, entered = begun.copy(), row, np.full(n, lost)
    inner = np.flatnonzero(~first)
    while True:
        again = inner[entered[inner] != ended[inner - 1]]
        if not len(again):
            return begun
        # from the state in which the block before ended until both parses are in one state
        row = entered[again] = ended[again - 1]
        ended[again] = alone[-1, again] & ~1
        change, open_ = np.zeros(len(again), dtype=np.int32), np.arange(len(again))
        for k in range(steps):
            at = again[open_]
            row, usual = table.take(row | columns[k, at]), alone[k, at]
            change[open_] += (row & 1) - (usual & 1)
            apart = (row ^ usual) > 1
            open_, row = open_[apart], row[apart] & ~1
            if not len(open_):
                break
        ended[again[open_]] = row
        begun[again] = by_itself[again] + change


class Model:
    """The automata of all languages; built once per worker from the sample."""

    def __init__(self, sample: list[tuple[str, list[str]]], letters: int = SAMPLE_LETTERS) -> None:
        self.classes = alphabet([t for _, texts in sample for t in texts])
        encoded, sizes = [], []
        for _, texts in sample:
            symbols, ends, n = self._symbols(pa.array(texts, pa.large_string()))
            sizes.append(min(letters, int(n.sum())))
            # as many symbols as the first ``letters`` letters have
            encoded.append(symbols[: int(letters * max(1.0, len(symbols) / max(1, n.sum())))])
        longest = max(sizes, default=0)
        least = max(1, min(LEAST_LETTERS, longest // 4))
        chosen = [k for k, n in enumerate(sizes) if n >= least]
        self.languages = [sample[k][0] for k in chosen]
        top = max([_UNKNOWN, *(int(encoded[k].max()) for k in chosen)])
        self.width = 1 << int(top).bit_length()
        self.tables = [automaton(encoded[k], self.width) for k in chosen]
        # the language with more text matches longer
        self.weights = np.array([math.log(sizes[k] + 1) / math.log(longest + 1) for k in chosen])

    def _symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, n + 1 offsets, letters by row)."""
        points, ends = codepoints(texts)
        stay, ends = squeeze(self.classes[points], ends)
        symbols, at = spelled(self.classes[points[stay]], points[stay], ends)
        return symbols, at, np.diff(ends)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by row and language, letters by row)."""
        symbols, ends, letters = self._symbols(texts)
        # a symbol that no sample has is like any other such one
        symbols = np.where(symbols < self.width, symbols, _UNKNOWN).astype(np.uint8)
        sizes = np.diff(ends)
        blocks = -(-sizes // BLOCK)
        edges = np.concatenate([[0], np.cumsum(blocks)])
        # place of each symbol in the blocks laid side by side
        lanes = np.zeros(edges[-1] * BLOCK, dtype=np.uint8)
        lanes[np.arange(len(symbols)) + np.repeat(edges[:-1] * BLOCK - ends[:-1], sizes)] = symbols
        columns = np.ascontiguousarray(lanes.reshape(-1, BLOCK).T)
        out = np.zeros((len(sizes), len(self.tables)), dtype=np.int64)
        some = np.flatnonzero(blocks)
        first = np.zeros(edges[-1], dtype=bool)
        first[edges[some]] = True
        if len(some):
            for k, table in enumerate(self.tables):
                out[some, k] = np.add.reduceat(phrases(columns, first, table, self.width), edges[some])
        return out, letters


def labelled(docs: DataFrame, rows: int = SAMPLE_ROWS, letters: int = SAMPLE_LETTERS, lang_col: str = "lang", text_col: str = "text") -> list[tuple[str, list[str]]]:
    """The labelled sample: per language whole texts until they have ``letters``.

    Texts are taken in the order of a hash, each once; those without a letter
    are passed over. ``rows`` at a time are drawn, and more for the languages
    that don't have ``letters`` yet. Only as many texts are kept as reach twice
    ``letters``, so what comes to the driver is bounded.
    """
    lang, text = col(lang_col).cast("string"), col(text_col)
    found = docs.filter(lang.isNotNull()).select(lang.alias("lang"), F.xxhash64(text).alias("order"), F.length(F.regexp_replace(text, r"\P{L}+", "")).alias("n")).filter("n > 0")
    nth = F.dense_rank().over(Window.partitionBy("lang").orderBy("order"))
    chosen: list[tuple[str, int]] = []
    open_ = found
    while True:
        drawn: dict[str, list[tuple[int, int]]] = {}
        for r in open_.withColumn("nth", nth).filter(F.col("nth") <= rows).groupBy("lang", "order").agg(F.min("n").alias("n")).collect():
            drawn.setdefault(r["lang"], []).append((r["order"], r["n"]))
        short = [language for language, texts in drawn.items() if len(texts) >= rows and sum(n for _, n in texts) < letters]
        for language in drawn.keys() - set(short):
            so_far = 0
            for order, n in sorted(drawn[language]):
                if so_far < 2 * letters:
                    chosen.append((language, order))
                so_far += n
        if not short:
            break
        open_, rows = found.filter(F.col("lang").isin(short)), rows * 8
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, order long")
    texts = docs.select(lang.alias("lang"), F.xxhash64(text).alias("order"), text.alias("text"))
    by: dict[str, dict[int, str]] = {}
    picked = texts.join(F.broadcast(wanted), ["lang", "order"]).groupBy("lang", "order").agg(F.min("text").alias("text"))
    for r in picked.collect():
        by.setdefault(r["lang"], {})[r["order"]] = r["text"]
    return [(language, [t for _, t in sorted(by[language].items())]) for language in sorted(by)]


def identify(docs: DataFrame, train: DataFrame | None = None, reject: float = REJECT, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] | None = None, found: tuple[str, str] = ("predicted", "rate")) -> DataFrame:
    """docs with ``predicted`` (null: rejected) and ``rate``, phrases per letter.

    ``train`` has the labelled rows, docs itself if it is not given; ``keep``
    names the columns of docs that the result has, all if it is not given; ``found``
    are the new columns' names. Text that is null, empty or without a letter is
    rejected with a null rate, and so is every text if no row is labelled. Of equal
    languages the first by name wins. Repeated rows give equal results, long texts
    are parsed whole, an empty table gives none. A column of docs that is named
    like a new one gives way to it. Labels whose sample is below ``LEAST_LETTERS``
    are never predicted, and change nothing for the others.
    """
    sample = labelled(docs if train is None else train, lang_col=lang_col, text_col=text_col)
    source = docs.select(*[col(c) for c in (keep or docs.columns)])
    source = without(source, found)
    n = len(source.columns)
    shown = [k for k, c in enumerate(source.columns) if c.lower() == text_col.lower()]
    out = T.StructType([*source.schema.fields, T.StructField(found[0], T.StringType()), T.StructField(found[1], T.DoubleType())])
    if not shown:
        source = without(docs, found).select(*[col(c) for c in source.columns], col(text_col)) if text_col.lower() not in map(str.lower, found) else docs.select(*[col(c) for c in source.columns], col(text_col))
    at = shown[0] if shown else n
    key = hash(str(sample))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept("automata", lambda: Model(sample), key)
        names = np.array([*model.languages, None], dtype=object)
        for batch in batches:
            for part in slices(batch, at):
                counts, sizes = model.counts(part.column(at))
                if model.languages:
                    best = (counts * model.weights).argmin(axis=1)
                    count = counts[np.arange(len(best)), best]
                else:
                    best = count = np.zeros(len(sizes), dtype=int)
                known = (sizes > 0) & bool(model.languages)
                # the last phrase is cut off by the text's end
                fits = count - 1 <= reject * sizes
                choice = np.where(known & fits, best, len(model.languages))
                fields = [*(part.schema.field(k) for k in range(n)), pa.field(found[0], pa.string()), pa.field(found[1], pa.float64())]
                rate = count / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(names[choice].tolist(), pa.string()), pa.array(rate, mask=~known)], schema=pa.schema(fields))

    return source.mapInArrow(rows, out)


def keep_identified(docs: DataFrame, lang_col: str = "lang", **how: object) -> DataFrame:
    """docs without the rejected ones; the language found replaces the label.

    All columns stay as they are named, whatever their names.
    """
    names = fresh(docs, "predicted", "rate")
    found = identify(docs, lang_col=lang_col, found=(names[0], names[1]), **how).filter(col(names[0]).isNotNull())
    return found.select(*[col(names[0]).alias(c) if c.lower() == lang_col.lower() else col(c) for c in docs.columns])

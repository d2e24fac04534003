"""Byte-level BPE encoding and decoding: speculate and verify.

A text is cut into words by the vocabulary's pattern. Each word's greedy longest
matches are a guess at its tokens. A token sequence is the true encoding exactly
if every two neighbours would be kept apart by BPE, so all neighbouring pairs are
checked at once by undoing merges from the cut outwards; only words with a pair
that fails are merged exactly, rank by rank, many words in lockstep. Results are
kept per worker by a hash of the word, within a bound, so a word is encoded about
once. Its ids are decoded again when they are kept, and all words of a slice are
compared with what the kept ones spell, in blocks of eight bytes, which also finds a
hash that two words share; such a slice is encoded without what was kept.

Map only: one scan, no shuffle. Words are cut, hashed and looked up as arrays over
a slice of texts, and long texts in pieces cut where no token can reach across.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.frames import col
from foliant.llm.text import kept, mix, slices, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SAFE = regex.compile(r"(?<=\S) (?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])|(?<=\S)(?=\n)")
_PIECE = 1 << 20
#: Words and ids that a worker keeps, some 30 MB with what they spell.
_WORDS, _IDS = 1 << 19, 1 << 21
#: A word of more bytes is hashed and compared by itself, not in blocks.
_BLOCKS = 64
#: A word of more bytes isn't guessed at but merged at once, by a heap.
_LONG = 1 << 10
#: Words of about one length are merged in lockstep, longer ones one by one.
_WIDTHS = (6, 8, 10, 13, 18, 28, 64)
#: Bytes of text at once.
_SLICE = 1 << 20
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.int64(1 << 40)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_OTHER, _LETTER, _NUMBER, _WHITE, _SPACE = range(5)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Bpe:
    """A vocabulary; tokens are numbered by rank inside, by id outside."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        rank = {bytes([b]): b for b in range(256)}
        ids = [0] * 256
        for letter, b in letters.items():
            ids[b] = model["vocab"][letter]
        left, right = list(range(256)), list(range(256))
        spell = {letter: bytes([b]) for letter, b in letters.items()}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            for x in (a, b):
                if x not in spell:
                    spell[x] = bytes(letters[c] for c in x)
            whole = spell[a] + spell[b]
            if whole in rank:
                continue
            rank[whole] = len(left)
            left.append(rank[spell[a]])
            right.append(rank[spell[b]])
            ids.append(model["vocab"][a + b])
        self.left, self.right = np.array(left), np.array(right)
        self.ids = np.array(ids, dtype=np.int32)
        self.rank_of_id = np.full(self.ids.max() + 1, -1, dtype=np.int64)
        self.rank_of_id[self.ids] = np.arange(len(ids))
        self.tokens = sorted(rank, key=rank.__getitem__)
        merged = np.arange(256, len(left))
        codes = (self.left[256:] << 32) | self.right[256:]
        self._pairs = _Table(codes.astype(np.uint64), merged)
        self.merge_of = dict(zip(codes.tolist(), merged.tolist()))
        self._bytes = np.full(1 << 16, _NONE)
        plain = (self.left[256:] < 256) & (self.right[256:] < 256)
        self._bytes[self.left[256:][plain] << 8 | self.right[256:][plain]] = merged[plain]
        data = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        lengths = np.array([len(t) for t in self.tokens])
        self.starts, self.lengths, self.bytes = np.cumsum(lengths) - lengths, lengths, data
        self.longest = int(lengths.max())
        self._spelling = pa.array(self.tokens, pa.large_binary())
        total = _prefix(data)
        self._whole = _Table(_part(total, self.starts, self.starts + lengths), np.arange(len(left)))
        # which lengths tokens of the same first three bytes have, those of 63 and more as one
        self._opening = np.zeros(1 << 16, dtype=np.uint64)
        np.bitwise_or.at(self._opening, self._first(np.append(data, [0, 0]).astype(np.uint32), self.starts[lengths > 2]), np.uint64(1) << np.minimum(lengths[lengths > 2], 63).astype(np.uint64))
        self.forget()

    # -- the three steps

    @staticmethod
    def _first(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (data[at] * 40503 ^ data[at + 1] * 30011 ^ data[at + 2] * 257) & 0xFFFF

    def greedy(self, data: np.ndarray, total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, their words) of greedy longest match, in order of word and place.

        total: the prefix hashes of the bytes that starts and stops refer to.
        """
        padded = np.append(data, [0, 0]).astype(np.uint32)
        at, word = starts.copy(), np.arange(len(starts))
        tokens, owners = [], []
        while len(word):
            found = np.full(len(word), -1, dtype=np.int64)
            room = np.minimum(stops[word] - at, self.longest)
            may = self._opening[self._first(padded, at)]
            open_ = np.arange(len(word))
            for size in range(int(room.max()), 0, -1):
                now = open_[room[open_] >= size]
                if size > 2:
                    now = now[may[now] >> np.uint64(min(size, 63)) & np.uint64(1) > 0]
                if not len(now):
                    continue
                found[now] = self._whole.find(_part(total, at[now], at[now] + size))
                open_ = open_[found[open_] < 0]
                if not len(open_):
                    break
            tokens.append(found)
            owners.append(word)
            at = at + self.lengths[found]
            rest = at < stops[word]
            at, word = at[rest], word[rest]
        if not tokens:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        flat, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each pair of tokens apart where they meet."""
        out = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NONE)
        while len(at):
            merged = self._pairs.find((a << 32 | b).astype(np.uint64))
            bad = (merged >= 0) & (merged < limit)
            out[at[bad]] = False
            # undo the later of the two merges; where that token is a byte, the other's
            first = a > b
            na, nb = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            stuck = np.where(first, na == a, nb == b)
            limit = np.where(first ^ stuck, a, b + 1)
            na, nb = np.where(stuck & ~first, self.right[a], na), np.where(stuck & first, self.left[b], nb)
            done = stuck & np.where(first, nb == b, na == a)
            go = ~bad & ~done
            at, a, b, limit = at[go], na[go], nb[go], limit[go]
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, n + 1 offsets): exact, by merging the pair of least rank again and again."""
        sizes = stops - starts
        lots = [(np.flatnonzero((sizes > low) & (sizes <= high)), high) for low, high in zip((0, *_WIDTHS), _WIDTHS)]
        made = [self._merge_rows(data, starts[lot], sizes[lot], high) for lot, high in lots]
        rest = np.flatnonzero(sizes > _WIDTHS[-1])
        long = [self._merge_long(data[starts[k] : stops[k]].tobytes()) for k in rest]
        counts = np.zeros(len(starts), dtype=np.int64)
        for (lot, _), (_, n) in zip(lots, made):
            counts[lot] = n
        counts[rest] = [len(x) for x in long]
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ends[-1], dtype=np.int64)
        for (lot, _), (flat, n) in zip(lots, made):
            out[np.repeat(ends[lot], n) + _counting(n)] = flat
        for k, x in zip(rest, long):
            out[ends[k] : ends[k + 1]] = x
        return out, ends

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many by word) of words of at most ``width`` bytes, in lockstep."""
        row = np.full((len(starts), width + 1), -1, dtype=np.int64)
        inside = np.arange(width + 1)[None, :] < sizes[:, None]
        row[inside] = data[np.repeat(starts, sizes) + _counting(sizes)]
        both = inside[:, 1:]
        ranks = np.full((len(starts), width), _NONE)
        ranks[both] = self._bytes[row[:, :-1][both] << 8 | row[:, 1:][both]]
        alive = np.arange(len(starts))
        columns = np.arange(width)[None, :]
        while len(alive):
            now = ranks[alive]
            best = now.argmin(axis=1)
            least = now[np.arange(len(alive)), best]
            go = least < _NONE
            alive, best, now, least = alive[go], best[go], now[go], least[go]
            if not len(alive):
                break
            part = row[alive]
            part[np.arange(len(alive)), best] = least
            after = columns > best[:, None]
            row[alive, :-1] = np.where(after, part[:, 1:], part[:, :-1])
            row[alive, -1] = -1
            now[:, :-1] = np.where(after[:, :-1], now[:, 1:], now[:, :-1])
            now[:, -1] = np.where(after[:, -1], _NONE, now[:, -1])
            ranks[alive] = now
            for near in (best - 1, best):
                ok = near >= 0
                r, c = alive[ok], near[ok]
                ranks[r, c] = self._pair_ranks(row[r, c], row[r, c + 1])
        held = row >= 0
        return row[held], held.sum(axis=1)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self._pairs.find(((a << 32) | (b & 0xFFFFFFFF)).astype(np.uint64))
        return np.where((found >= 0) & (a >= 0) & (b >= 0), found, _NONE)

    def _merge_long(self, word: bytes) -> np.ndarray:
        token: list[int] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, k) for k in range(len(word) - 1) if (r := self.merge_of.get(token[k] << 32 | token[k + 1])) is not None]
        heapq.heapify(heap)
        n = len(word)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if token[k] < 0 or j >= n or self.merge_of.get(token[k] << 32 | token[j]) != r:
                continue
            token[k], token[j] = r, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (x := self.merge_of.get(r << 32 | token[after[k]])) is not None:
                    heapq.heappush(heap, (x, k))
            p = before[k]
            if p >= 0 and (x := self.merge_of.get(token[p] << 32 | r)) is not None:
                heapq.heappush(heap, (x, p))
        return np.array([t for t in token if t >= 0], dtype=np.int64)

    # -- words and texts

    def words(self, data: np.ndarray, total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, n + 1 offsets) of words in the bytes ``data``."""
        usual = np.flatnonzero(stops - starts <= _LONG)
        tokens, owner = self.greedy(data, total, starts[usual], stops[usual])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        code, back = np.unique(tokens[inside] << 32 | tokens[inside + 1], return_inverse=True)
        good = self.apart(code >> 32, code & 0xFFFFFFFF)[back]
        rest = np.ones(len(starts), dtype=bool)
        rest[usual] = False
        rest[usual[owner[inside[~good]]]] = True
        failing = np.flatnonzero(rest)
        counts = np.zeros(len(starts), dtype=np.int64)
        counts[usual] = np.bincount(owner, minlength=len(usual))
        if not len(failing):
            return tokens, np.concatenate([[0], np.cumsum(counts)])
        exact, edges = self.merge(data, starts[failing], stops[failing])
        counts[failing] = np.diff(edges)
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ends[-1], dtype=np.int64)
        put = np.ones(ends[-1], dtype=bool)
        spans = np.repeat(ends[failing], counts[failing]) + _counting(counts[failing])
        put[spans] = False
        out[spans] = exact
        out[put] = tokens[~rest[usual][owner]]
        return out, ends

    def forget(self) -> None:
        """Drop the words that are kept."""
        self._kept = _Table(np.empty(0, np.uint64), np.empty(0, np.int64), bits=12)
        # by word: its first block, its bytes << 32 | its ids, where its ids and all its blocks begin
        self._head, self._size = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._from, self._block_from = np.empty(0, np.int64), np.empty(0, np.int64)
        self._store, self._blocks = np.empty(0, np.int32), np.empty(0, np.uint64)
        self._longer: dict[int, bytes] = {}

    def _places(self, data: np.ndarray, cut: _Words) -> np.ndarray:
        """Where words are among those kept; new ones are encoded."""
        place = self._kept.find(cut.keys)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place
        _, first, back = np.unique(cut.keys[new], return_index=True, return_inverse=True)
        n = len(self._head)
        if n and (n + len(first) > _WORDS or len(self._store) > _IDS):
            self.forget()
            return self._places(data, cut)
        one = new[first]
        sizes = cut.sizes[one]
        flat = data[np.repeat(cut.starts[one], sizes) + _counting(sizes)]
        stops = np.cumsum(sizes)
        tokens, ends = self.words(flat, _prefix(flat), stops - sizes, stops)
        ids = self.ids[tokens]
        spelled = np.concatenate([[0], np.cumsum(self.lengths[tokens])])[ends]
        back_again = np.frombuffer(self.decode(ids), dtype=np.uint8)
        own = _Words(back_again, spelled[:-1], np.diff(spelled))
        held = np.minimum(own.sizes, _BLOCKS) + 7 >> 3
        at = np.cumsum(held) - held
        blocks = np.empty(held.sum(), dtype=np.uint64)
        for k, (some, block) in enumerate(own.blocks):
            blocks[at[some] + k] = block
        self._longer |= {n + k: back_again[spelled[k] : spelled[k + 1]].tobytes() for k in own.long.tolist()}
        self._head = np.concatenate([self._head, own.blocks[0][1]])
        self._size = np.concatenate([self._size, own.sizes << 32 | np.diff(ends)])
        self._from = np.concatenate([self._from, ends[:-1] + len(self._store)])
        self._block_from = np.concatenate([self._block_from, at + len(self._blocks)])
        self._store, self._blocks = np.concatenate([self._store, ids]), np.concatenate([self._blocks, blocks])
        self._kept = self._kept.with_more(cut.keys[one], np.arange(n, n + len(one)))
        place[new] = n + back
        return place

    def _spell(self, data: np.ndarray, cut: _Words, place: np.ndarray) -> bool:
        """Whether the kept words at ``place`` are those of the text, byte by byte."""
        if not (np.array_equal(self._size[place] >> 32, cut.sizes) and np.array_equal(self._head[place], cut.blocks[0][1])):
            return False
        for k, (some, block) in enumerate(cut.blocks[1:], 1):
            if not np.array_equal(self._blocks[self._block_from[place[some]] + k], block):
                return False
        return all(self._longer[int(place[k])] == data[cut.starts[k] : cut.starts[k] + cut.sizes[k]].tobytes() for k in cut.long)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, edges = utf8(texts)
        starts = np.flatnonzero(byte_starts(data, edges))
        cut = _Words(data, starts, np.diff(starts, append=len(data)))
        place = self._places(data, cut)
        if not self._spell(data, cut, place):
            self.forget()  # two words with one hash: by themselves they don't meet
            return self._apart(texts)
        counts, at = self._size[place] & 0xFFFFFFFF, self._from[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(ends[-1], dtype=np.int32)
        ids[ends[:-1]] = self._store[at]
        rest = np.flatnonzero(counts > 1)
        at, to, counts = at[rest], ends[:-1][rest], counts[rest]
        for k in range(1, 8):
            ids[to + k] = self._store[at + k]
            go = counts > k + 1
            at, to, counts = at[go], to[go], counts[go]
        if len(counts):
            inside = _counting(counts - 8) + 8
            ids[np.repeat(to, counts - 8) + inside] = self._store[np.repeat(at, counts - 8) + inside]
        return ids, ends[np.searchsorted(starts, edges)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, n + 1 offsets); null counts as empty."""
        found, sizes = [np.empty(0, np.int32)], []
        data, edges = utf8(texts)
        low = 0
        # runs of texts, or one long text in pieces
        cuts = np.flatnonzero(np.diff(edges) > _PIECE).tolist()
        for row in [*cuts, len(texts)]:
            lots = [(texts.slice(low, row - low), False)] if row > low else []
            if row < len(texts):
                lots.append((pa.array(pieces(texts[row].as_py()), pa.large_string()), True))
            for lot, whole in lots:
                each = [(lot.slice(k, 1), 1) for k in range(len(lot))] if whole else [(lot, len(lot))]
                so_far = 0
                for part, _ in each:
                    ids, ends = self._encode(part)
                    found.append(ids)
                    if whole:
                        so_far += len(ids)
                    else:
                        sizes.append(np.diff(ends))
                if whole:
                    sizes.append(np.array([so_far]))
            low = row + 1
        return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else np.empty(0, np.int64))])

    def _apart(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode, each word by itself and nothing kept."""
        out, sizes = [np.empty(0, np.int32)], []
        for text in texts.to_pylist():
            before = sum(map(len, out))
            for word in PATTERN.findall(text or ""):
                data = np.frombuffer(word.encode(), dtype=np.uint8)
                tokens, _ = self.words(data, _prefix(data), np.zeros(1, np.int64), np.array([len(data)]))
                out.append(self.ids[tokens])
            sizes.append(sum(map(len, out)) - before)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        _, _, data = self._spelling.take(pa.array(self.rank_of_id[ids])).buffers() if len(ids) else (None, None, None)
        return memoryview(data).tobytes()[: int(self.lengths[self.rank_of_id[ids]].sum())] if len(ids) else b""


class _Words:
    """Words in bytes: their keys, and their bytes in blocks of eight.

    blocks: for each k, which words have a k-th block, and those, beyond the word 0.
    long: the words of more than ``_BLOCKS`` bytes.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.starts, self.sizes = starts, sizes
        padded = np.append(data, np.zeros(8, np.uint8))
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        some: np.ndarray | slice = slice(None)
        at, left = starts, sizes
        self.blocks: list[tuple[np.ndarray | slice, np.ndarray]] = []
        self.keys = sizes.astype(np.uint64) * _BASE
        for k in range(_BLOCKS // 8):
            block = eight[at] & _MASKS[np.minimum(left, 8)]
            self.blocks.append((some, block))
            self.keys[some] = (mix(self.keys[some]) if k else self.keys) ^ block
            go = np.flatnonzero(left > 8)
            if not len(go):
                break
            some, at, left = go if k == 0 else some[go], at[go] + 8, left[go] - 8
        self.long = np.flatnonzero(sizes > _BLOCKS)
        for k in self.long:
            word = data[starts[k] : starts[k] + sizes[k]].tobytes()
            self.keys[k] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), dtype=np.uint64)[0]


def classes() -> np.ndarray:
    """Code point -> letter, number, white space, the plain space, or other."""

    def make() -> np.ndarray:
        every = "".join(map(chr, range(0x110000)))
        out = np.zeros(0x110000, dtype=np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        out[0x20] = _SPACE
        return out

    return kept("classes", make)


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where PATTERN's matches begin, for texts in a row with n + 1 offsets."""
    return _starts(classes()[points], points, ends)


def byte_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As word_starts, for texts as bytes; those of a letter are of its kind."""
    every = classes()
    raw = data.tobytes()
    kind = np.frombuffer(bytearray(raw.translate(every[:256].tobytes())), dtype=np.uint8)
    if not raw.isascii():
        str(raw, "utf-8")  # fails on what is no UTF-8
        first = np.flatnonzero(data >= 0xC0)
        lead = data[first].astype(np.int32)
        code = np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07))
        parts = []
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            so_far = slice(None) if k == 1 else np.flatnonzero(lead >= least)
            at = first[so_far] + k
            code[so_far] = code[so_far] << 6 | data[at] & 0x3F
            parts.append((so_far, at))
        found = every[code]
        kind[first] = found
        for so_far, at in parts:
            kind[at] = found[so_far]
    return _starts(kind, data, ends)


def _starts(kind: np.ndarray, units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin, by the kinds of code points or of bytes; ``kind`` is changed."""
    n = len(units)
    space = kind == _SPACE
    np.minimum(kind, _WHITE, out=kind)
    out = np.empty(n, dtype=bool)
    if not n:
        return out
    np.not_equal(kind[1:], kind[:-1], out=out[1:])
    inner = ends[:-1][ends[:-1] < n]
    begins = np.zeros(n + 1, dtype=bool)
    begins[inner] = begins[n] = True
    out[inner] = True
    # the last of a run of white space stands alone, or before what follows if it is a space
    white = kind == _WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~begins[1:n])
    out[last + 1] = ~space[last]
    if units.dtype == np.uint8:  # from a letter's last byte to its first
        while (inside := units[last] & 0xC0 == 0x80).any():
            last = last - inside
    out[last] = True
    # contractions: an apostrophe that nothing is before in its word
    quote = np.flatnonzero((units == 39) & out)
    if len(quote):
        padded = np.append(units, np.zeros(3, units.dtype))
        one, two = padded[quote + 1], padded[quote + 2]
        near = np.minimum(quote + 1, n), np.minimum(quote + 2, n)
        single = np.isin(one, [ord(c) for c in "sdmt"]) & ~begins[near[0]]
        pair = ((one == 108) & (two == 108) | (one == 118) & (two == 101) | (one == 114) & (two == 101)) & ~begins[near[0]] & ~begins[near[1]]
        out[quote[single | pair] + 1] = False
        after = np.concatenate([quote[single] + 2, quote[pair] + 3])
        out[after[after < n]] = True
    return out


def _counting(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... again for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def pieces(text: str) -> Iterator[str]:
    """The text, cut before spaces that begin a word if it is long."""
    at = 0
    while len(text) - at > _PIECE:
        m = _SAFE.search(text, at + _PIECE)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) <= len(data):
        n = max(len(data) + 1, _SLICE + 4096)
        up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _powers[0][: len(data)]
    np.cumsum(terms, out=total[1:])
    return total


def _part(total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return mix((total[stops] - total[starts]) * _powers[1][starts])


class _Table:
    """Keys to numbers, by open addressing that probes all keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 4) -> None:
        self.bits = max(bits, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.held = 0
        self.keys, self.values = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        self.put(keys, values)

    def with_more(self, keys: np.ndarray, values: np.ndarray) -> _Table:
        """This table or a larger one, with keys that it doesn't have yet."""
        if 2 * (self.held + len(keys)) <= len(self.keys):
            self.put(keys, values)
            return self
        full = self.values >= 0
        return _Table(np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values]), self.bits + 1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that aren't there."""
        size = len(self.keys)
        self.held += len(keys)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.values[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            won = first[free[first]]
            self.keys[slot[won]], self.values[slot[won]] = keys[left[won]], values[left[won]]
            rest = np.ones(len(left), dtype=bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = self._slot(keys)
        held = self.values[slot].astype(np.int64)
        out = np.where(self.keys[slot] == keys, held, -1)
        open_ = np.flatnonzero((out < 0) & (held >= 0))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.values[at]
            hit = (held >= 0) & (self.keys[at] == keys[open_])
            out[open_[hit]] = held[hit]
            go = (held >= 0) & ~hit
            open_, at = open_[go], at[go]
        return out


def vocabulary(path: str) -> Bpe:
    """The vocabulary of this worker, loaded once."""
    return kept("vocabulary", lambda: Bpe(path), path)


def encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of every document, whole texts.

    ``exact`` says that the decoded ids are the text's bytes. A null text has
    null in all three; an empty one no ids. Special tokens' names in a text are
    ordinary text. Repeated rows give equal results; other columns are ignored;
    an empty table gives none. ``path`` must be readable on every executor.
    """
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    out = T.StructType([narrow.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("exact", T.BooleanType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                texts = part.column(1)
                none = texts.is_null().to_numpy(zero_copy_only=False)
                ids, ends = bpe.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=pa.array(none))
                exact = _round_trip(bpe, texts, ids, ends)
                counts = pa.array(np.diff(ends), mask=none)
                kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
                yield pa.RecordBatch.from_arrays([part.column(0), counts, lists.cast(kind), pa.array(exact, mask=none)], names=["doc_id", "n_tokens", "ids", "exact"])

    return narrow.mapInArrow(rows, out)


def _round_trip(bpe: Bpe, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data, edges = utf8(texts)
    back = np.frombuffer(bpe.decode(ids), dtype=np.uint8)
    made = np.concatenate([[0], np.cumsum(bpe.lengths[bpe.rank_of_id[ids]])])[ends]
    if len(back) == len(data) and (back == data).all():
        return np.diff(made) == np.diff(edges)
    return np.array([np.array_equal(back[made[k] : made[k + 1]], data[edges[k] : edges[k + 1]]) for k in range(len(texts))], dtype=bool)


def decode(encoded: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) back from ids; null ids give a null text.

    Bytes that are no UTF-8 become U+FFFD; an id that the vocabulary lacks fails.
    """
    narrow = encoded.select(col(id_col).alias("doc_id"), col(ids_col).cast("array<int>").alias("ids"))
    out = T.StructType([narrow.schema["doc_id"], T.StructField("text", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                known = None if not ids.is_valid else np.asarray(ids.as_py(), dtype=np.int64)
                if known is not None and len(known) and (known.min() < 0 or known.max() >= len(bpe.rank_of_id) or (bpe.rank_of_id[known] < 0).any()):
                    raise ValueError("an id is not in the vocabulary")
                texts.append(None if known is None else bpe.decode(known).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return narrow.mapInArrow(rows, out)

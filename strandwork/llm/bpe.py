"""Operator 8: BPE encoding and decoding, speculate and verify.

A greedy longest match proposes each distinct pre-token's tokens. A sequence of tokens is what merging by rank gives
if and only if that holds for each pair of neighbours on its own: up to the first merge across a border, the two sides
of that border evolve as they would alone. So the pairs of all proposed pre-tokens are checked at once, as numbers; a
pair is merged exactly the first time it is seen, and only pre-tokens with a pair that fails are merged in full. All
three steps run over arrays of all new pre-tokens of a chunk, not over words in a loop.

Files: a BPE model of the tokenizers library with byte-level symbols and a suffix that ends words, normalised by
NFC and lower case. Special tokens in a text are found before that, as the library does it. Words of ASCII and of the
letters U+00C0 to U+00FF are lower-cased and cut by tables; all others by the library's own normaliser and
pre-tokeniser, so its Unicode version decides, not Python's. Pre-tokens are held apart by 64 bits of hash.

Each document is encoded where it is read, without a shuffle; tables of distinct pre-tokens are bounded (CACHE).

Cases: a null or empty text has no tokens; a text without white space is one word, of any length (pre-tokens of more
than SHORT bytes are merged in full, by a queue); a very long text is encoded in parts of about CHUNK bytes; equal rows
have equal results, ties of rank go to the leftmost pair; an empty table gives an empty result; of the input only
doc_id is kept, so extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

#: Distinct pre-tokens that a worker remembers, besides those of the chunk at hand.
CACHE = 200_000
#: Pairs of tokens whose verdict a worker remembers.
PAIRS = 500_000
#: Bytes of text that are encoded together.
CHUNK = 1 << 19
#: Bytes of ids and decoded texts that are handed on together.
FLUSH = 1 << 20
#: Symbols up to which pre-tokens are proposed and merged as arrays.
SHORT = 48
_NONE = 1 << 60
_ID = (1 << 20) - 1
_LETTER, _DIGIT, _OTHER = 0, 1, 2


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> np.ndarray:
    """Of each byte of a plain word: letter, digit or other."""
    kinds = np.full(256, _OTHER, np.int8)
    for low, high in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        kinds[low : high + 1] = _LETTER
    kinds[0x30:0x3A] = _DIGIT
    return kinds


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Table:
    """Values (not negative) of 64-bit keys, looked up for whole arrays: open addressing, at most an eighth full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = K.U(64 - max(4, (8 * max(1, len(keys)) - 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.zeros(size + 64, K.U), np.full(size + 64, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):  # the first that asks for a free slot has it, the others go on to the next
            free = self.values[slot[todo]] < 0
            _, firsts = np.unique(slot[todo], return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[firsts] = True
            mine &= free
            at = todo[mine]
            self.keys[slot[at]], self.values[slot[at]] = keys[at], values[at]
            todo = todo[~mine]
            slot[todo] += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * K.U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        slot = self._slots(keys)
        out = self.values[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        out[other] = -1
        todo, slot = other, slot[other] + 1
        while len(todo):
            value = self.values[slot]
            here = self.keys[slot] == keys[todo]
            out[todo[here & (value >= 0)]] = value[here & (value >= 0)]
            on = ~here & (value >= 0)
            todo, slot = todo[on], slot[on] + 1
        return out


class Known:
    """The tokens of pre-tokens by hash: about ``size`` of those that were asked for last."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, flat: np.ndarray, first: np.ndarray) -> None:
        """New keys, in rising order, and their tokens."""
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, first[:-1] + len(self.flat))
        self.count = np.insert(self.count, at, np.diff(first))
        self.flat = np.concatenate([self.flat, flat])


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.end = path, model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n = max([*ids.values(), *self.special.values()]) + 1
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.last = np.array([ids[c + self.end] for c in symbols], np.int64)
        # Tokens as bytes, by whether they end a word.
        stems: dict[bool, list[tuple[bytes, int]]] = {False: [], True: []}
        names, parts = [b""] * self.n, [[]] * self.n
        for t, i in ids.items():
            ends = bool(self.end) and t.endswith(self.end)
            stem = bytes(byte_of[c] for c in (t.removesuffix(self.end) if ends else t))
            stems[ends].append((stem, i))
            names[i] = t.encode()
            symbol_ids = self.inner[list(stem)].tolist()
            parts[i] = [*symbol_ids[:-1], int(self.last[stem[-1]])] if ends else symbol_ids
        for t, i in self.special.items():
            names[i] = t.encode()
        self.inside, self.ending = (self._table(stems[x]) for x in (False, True))
        self.longest = max(len(s) for s, _ in stems[True])
        #: The longest token inside a word that begins with these two bytes.
        self.reach = np.ones(1 << 16, np.int64)
        for stem, _ in stems[False]:
            if len(stem) > 1:
                two = stem[0] << 8 | stem[1]
                self.reach[two] = max(self.reach[two], len(stem))
        self.part_first = np.r_[0, np.cumsum([len(p) for p in parts])]
        self.parts = np.array([x for p in parts for x in p], np.int64)
        #: What decoding writes of each token: its name and a space.
        self.name_first = np.r_[0, np.cumsum([len(x) + 1 for x in names])]
        self.names = np.frombuffer(b"".join(x + b" " for x in names), np.uint8)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], K.U)
        self.ranks = Table(keys, np.array([r << 20 | ids[a + b] for r, (a, b) in enumerate(merges)], np.int64))
        self.rank_of = None  # as a dict, for long pre-tokens
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = None
        self.byte_of = {ord(c): chr(b) for c, b in byte_of.items()}
        self.known = Known(CACHE)
        self.pairs, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        self.seen = self.merged = 0  # pre-tokens that were new, and that were merged in full

    @staticmethod
    def _table(stems: list[tuple[bytes, int]]) -> Table:
        data = np.frombuffer(b"".join(s for s, _ in stems), np.uint8)
        first = np.r_[0, np.cumsum([len(s) for s, _ in stems])]
        return Table(K.hashes(data)(first[:-1], first[1:]), np.array([i for _, i in stems], np.int64))

    # -- merging

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.ranks.get((a << 20 | b).astype(K.U).ravel()).reshape(a.shape)
        return np.where(got < 0, _NONE, got)

    def _merge_equal(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of as many symbols each, merged by rank, of equal ranks the leftmost first: (rows, sizes)."""
        width = m.shape[1]
        out, sizes = m.copy(), np.full(len(m), width)
        if width < 2:
            return out, sizes
        rows, ranks = np.arange(len(m)), self._rank(m[:, :-1], m[:, 1:])
        while len(rows) and width > 1:  # each row that is still here has merged as often as the others
            i = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), i]
            done = best == _NONE
            if done.any():
                out[rows[done], :width], sizes[rows[done]] = m[done], width
                go = ~done
                m, ranks, rows, i, best = m[go], ranks[go], rows[go], i[go], best[go]
            width -= 1
            each, columns = np.arange(len(rows)), np.arange(width)
            m[each, i] = best & _ID
            m = np.take_along_axis(m, columns + (columns > i[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= i[:, None]), 1)
            for changed, j in ((i < width - 1, i), (i > 0, i - 1)):
                e, j = each[changed], j[changed]
                ranks[e, j] = self._rank(m[e, j], m[e, j + 1])
        out[rows, :width], sizes[rows] = m, width
        return out, sizes

    def merge_all(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of symbols, all merged: tokens, and where each sequence's begin."""
        size = np.diff(first)
        got = np.zeros(len(size), np.int64)
        room = flat.astype(np.int64)  # each result fits where its symbols were
        for width in np.unique(size).tolist():
            rows = np.flatnonzero(size == width)
            if width > SHORT:
                for r in rows.tolist():
                    tokens = self.merge_long(flat[first[r] : first[r + 1]].tolist())
                    room[first[r] : first[r] + len(tokens)] = tokens
                    got[r] = len(tokens)
            elif width:
                at = first[rows][:, None] + np.arange(width)
                room[at], got[rows] = self._merge_equal(flat[at])
        return room[K.spread(first[:-1], got)], np.r_[0, np.cumsum(got)]

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for one sequence, by a queue."""
        if self.rank_of is None:
            has = self.ranks.values >= 0
            self.rank_of = dict(zip(self.ranks.keys[has].tolist(), self.ranks.values[has].tolist(), strict=True))
        n, find = len(parts), self.rank_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found >> 20, i, pair) for i in range(n - 1) if (found := find(pair := parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if parts[i] < 0 or j >= n or parts[i] << 20 | parts[j] != pair:
                continue
            parts[i], parts[j] = find(pair) & _ID, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := find(pair := parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(queue, (found >> 20, x, pair))
        return [p for p in parts if p >= 0]

    # -- speculation

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left of data[start:end]: tokens, and where each one's begin."""
        hash_of = K.hashes(data)
        pieces, tokens = [], []
        at, on = start.copy(), np.arange(len(start))
        while len(on):
            a, e = at[on], end[on]
            got, size = np.full(len(on), -1), e - a
            ends = np.flatnonzero(size <= self.longest)
            got[ends] = self.ending.get(hash_of(a[ends], e[ends]))
            open_ = np.flatnonzero(got < 0)  # all of these have two bytes or more
            limit = np.minimum(size[open_] - 1, self.reach[data[a[open_]].astype(np.int64) << 8 | data[a[open_] + 1]])
            for n in range(int(limit.max(initial=0)), 0, -1):
                now = np.flatnonzero(limit >= n)
                begin = a[open_[now]]
                found = self.inside.get(hash_of(begin, begin + n))
                hit = found >= 0
                rows = open_[now[hit]]
                got[rows], size[rows] = found[hit], n
                limit[now[hit]] = 0
            pieces.append(on)
            tokens.append(got)
            at[on] += size
            on = on[at[on] < end[on]]
        piece = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        order = np.argsort(piece, kind="stable")
        flat = np.concatenate(tokens)[order] if tokens else piece
        return flat, np.searchsorted(piece[order], np.arange(len(start) + 1))

    def _symbols_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of pre-tokens, and where each one's begin."""
        first = np.r_[0, np.cumsum(end - start)]
        flat = self.inner[data[K.spread(start, end - start)]]
        flat[first[1:] - 1] = self.last[data[end - 1]]
        return flat, first

    def fitting(self, codes: np.ndarray) -> np.ndarray:
        """For each pair of neighbours (a * n + b; a token alone: n * n + a): does merging its symbols give the same?"""
        keys, which = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        old = np.zeros(len(keys), bool)
        inside = at < len(self.pairs)
        old[inside] = self.pairs[at[inside]] == keys[inside]
        ok = np.zeros(len(keys), bool)
        ok[old] = self.verdicts[at[old]]
        new = ~old
        if new.any():
            a, b = np.divmod(keys[new], self.n)
            alone = a == self.n
            a = np.where(alone, b, a)
            size = np.diff(self.part_first)
            n_a, n_b = size[a], np.where(alone, 0, size[b])
            flat = self.parts[K.spread(np.stack([self.part_first[a], self.part_first[b]], 1).ravel(), np.stack([n_a, n_b], 1).ravel())]
            merged, first = self.merge_all(flat, np.r_[0, np.cumsum(n_a + n_b)])
            n = np.diff(first)
            one, two = merged[first[:-1]], merged[np.minimum(first[:-1] + 1, len(merged) - 1)]
            ok[new] = (one == a) & np.where(alone, n == 1, (n == 2) & (two == b))
            if len(self.pairs) > PAIRS:
                self.pairs, self.verdicts, new[:] = self.pairs[:0], self.verdicts[:0], True
            at = np.searchsorted(self.pairs, keys[new])
            self.pairs, self.verdicts = np.insert(self.pairs, at, keys[new]), np.insert(self.verdicts, at, ok[new])
        return ok[which]

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of distinct pre-tokens."""
        size = end - start
        short = np.flatnonzero(size <= SHORT)
        flat, first = self.propose(data, start[short], end[short])
        count = np.diff(first)
        # A pair stands at its second token; a token alone at itself.
        begins = np.zeros(len(flat), bool)
        begins[first[:-1]] = True
        second = np.flatnonzero(~begins)
        lone = first[:-1][count == 1]
        codes = np.concatenate([flat[second - 1] * self.n + flat[second], self.n * self.n + flat[lone]])
        bad = np.zeros(len(flat) + 1, np.int64)
        bad[1:][np.concatenate([second, lone])] = ~self.fitting(codes)
        bad = np.cumsum(bad)
        failed = np.ones(len(start), bool)  # the long ones, too
        failed[short] = bad[first[1:]] > bad[first[:-1]]
        rows = np.flatnonzero(failed)
        exact, exact_first = self.merge_all(*self._symbols_of(data, start[rows], end[rows]))
        self.seen += len(start)
        self.merged += len(rows)
        n = np.zeros(len(start), np.int64)
        n[short] = count
        n[rows] = np.diff(exact_first)
        source = np.zeros(len(start), np.int64)
        source[short] = first[:-1]
        source[rows] = exact_first[:-1] + len(flat)
        return np.concatenate([flat, exact])[K.spread(source, n)].astype(np.int32), np.r_[0, np.cumsum(n)]

    # -- texts

    def split(self, word: str) -> list[bytes | int]:
        """Pre-tokens of one word, as bytes, and the ids of special tokens: by the library."""
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_file(self.path)
        out: list[bytes | int] = []
        for part in self.specials.split(word) if self.specials else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                clean = self.library.normalizer.normalize_str(part)
                out += [p.translate(self.byte_of).encode("latin-1") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]
        return out

    def pieces(self, source: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Of the words source[begin:stop]: (bytes, start and end of each pre-token, where each word's begin, (pre-token, id) of the
        special ones, whose bytes are none)."""
        size = stop - begin
        data = source[K.spread(begin, size)]
        edge = np.r_[0, np.cumsum(size)]
        lead = np.r_[False, data[:-1] == 0xC3]
        odd = (data >= 0x80) & (data != 0xC3) & ~(lead & (data != 0x97) & (data != 0xB7))
        odd |= data == 0x27  # contractions
        odd |= (data == 0x3C) & np.r_[data[1:] == 0x7C, False]  # special tokens
        odd = np.r_[0, np.cumsum(odd)]
        by_library = odd[edge[1:]] > odd[edge[:-1]]
        high = lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        data = _LOWER[data]
        data[high] += 0x20
        kind = _CLASS[data]
        begins = np.r_[True, kind[1:] != kind[:-1]] | (kind == _DIGIT) if len(data) else np.zeros(0, bool)
        begins[edge[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.r_[start[1:], len(data)] if len(start) else start
        first = np.searchsorted(start, edge)
        rows = np.flatnonzero(by_library)
        if not len(rows):
            return data, start, end, first, []
        # The library's pre-tokens come after all others; each word then takes its own.
        more, at, ids = [], len(data), []
        starts, ends, counts = [], [], []
        for r in rows.tolist():
            cut = self.split(source[begin[r] : stop[r]].tobytes().decode("utf-8", "replace"))
            for p in cut:
                if isinstance(p, int):
                    ids.append((len(starts), p))
                    p = b""
                more.append(p)
                starts.append(at)
                at += len(p)
                ends.append(at)
            counts.append(len(cut))
        n, own = np.diff(first), first[:-1].copy()
        n[rows], own[rows] = counts, len(start) + np.r_[0, np.cumsum(counts)][:-1]
        order = K.spread(own, n)
        place = np.zeros(len(start) + len(starts), np.int64)
        place[order] = np.arange(len(order))
        all_start, all_end = np.r_[start, np.array(starts, np.int64)], np.r_[end, np.array(ends, np.int64)]
        data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
        return data, all_start[order], all_end[order], np.r_[0, np.cumsum(n)], [(int(place[len(start) + i]), t) for i, t in ids]

    def encode_words(self, source: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of distinct words, and where each one's begin."""
        data, start, end, first, special = self.pieces(source, begin, stop)
        keys, at, which = np.unique(K.hashes(data)(start, end), return_index=True, return_inverse=True)
        place = self.known.find(keys)
        new, old = np.flatnonzero((place < 0) & (end[at] > start[at])), np.flatnonzero(place >= 0)
        flat, edge = self.learn(data, start[at[new]], end[at[new]])
        if len(self.known.keys) > self.known.size:  # keep what is in use
            n = self.known.count[place[old]]
            kept = self.known.flat[K.spread(self.known.start[place[old]], n)]
            self.known.clear()
            self.known.add(keys[old], kept, np.r_[0, np.cumsum(n)])
        self.known.add(keys[new], flat, edge)
        place = self.known.find(keys)[which]
        begin, n, pool = self.known.start[place], self.known.count[place], self.known.flat
        if special:
            rows, ids = np.array([r for r, _ in special]), np.array([i for _, i in special], np.int32)
            begin[rows], n[rows] = len(pool) + np.arange(len(rows)), 1
            pool = np.concatenate([pool, ids])
        return pool[K.spread(begin, n)], np.r_[0, np.cumsum(n)][first]

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's decode() of a file without a decoder: the tokens' names, each with a space after it, and
        where each token's begin."""
        n = (self.name_first[1:] - self.name_first[:-1])[ids]
        return self.names[K.spread(self.name_first[ids], n)], np.r_[0, np.cumsum(n)]


@lru_cache(2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_texts(path: str, texts: pa.Array, cache: int = CACHE) -> Iterator[tuple[bytes, str]]:
    """(ids as little-endian uint32, decoded text) of each text. Words are encoded once per chunk of texts: no
    token reaches over white space."""
    t = load(path)
    t.known.size = cache
    held_ids, held_text = [], []
    for w, goes_on in K.parts_of(texts, CHUNK):
        _, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
        flat, first = t.encode_words(w.data, w.start[at], w.end[at])
        n = np.diff(first)[which]
        ids = flat[K.spread(first[:-1][which], n)]
        text, text_first = t.decoded(ids)
        edge = np.r_[0, np.cumsum(n)][w.first].tolist()
        raw = ids.astype("<u4")
        for a, b in zip(edge, edge[1:]):
            held_ids.append(raw[a:b].tobytes())
            held_text.append(text[text_first[a] : text_first[b]].tobytes())
            if not goes_on:
                yield b"".join(held_ids), b"".join(held_text)[:-1].decode()
                held_ids, held_text = [], []


def _encoder(path: str, column: int, make: Callable[[bytes, str], tuple], names: list[str], types: list[pa.DataType], cache: int = CACHE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for i, c in enumerate(batch.columns) if i != column]
            all_names = [n for i, n in enumerate(batch.schema.names) if i != column] + names

            def rows(at: int, made: list[tuple], kept=kept, all_names=all_names) -> pa.RecordBatch:
                new = [pa.array(list(m), k) for m, k in zip(zip(*made, strict=True), types, strict=True)]
                return pa.record_batch([c.slice(at, len(made)) for c in kept] + new, names=all_names)

            at, size, made = 0, 0, []
            for ids, decoded in encode_texts(path, batch.column(column), cache):
                made.append(make(ids, decoded))
                size += len(ids) + len(decoded)
                if size >= FLUSH:
                    yield rows(at, made)
                    at, size, made = at + len(made), 0, []
            if made:
                yield rows(at, made)
        K.trim()

    return run


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, cache: int = CACHE) -> DataFrame:
    """(doc_id, ids array<int>, decoded string). cache: distinct words that a worker remembers; fewer cost time, not
    results, and leave more memory to others."""
    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    make = lambda ids, decoded: (np.frombuffer(ids, "<i4"), decoded)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoder(path or default_path(), 1, make, ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()], cache), f"doc_id {kind}, ids array<int>, decoded string")


def _digest(ids: bytes, decoded: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode(), reduced where it is made."""
    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _encoder(path or default_path(), 1, _digest, names, [pa.int64(), pa.string(), pa.string()]), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))

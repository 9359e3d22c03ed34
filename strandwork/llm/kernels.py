"""Words and n-grams of whole Arrow batches as numpy arrays: no Python loop runs over words.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums over the batch's bytes and
then mixed; an n-gram's hash combines its words' hashes in the same way. Equal words have equal hashes in every
process: nothing depends on a seed that isn't here.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are handled at once; a longer document is handled alone.
CHUNK = 1 << 20
_P = U(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def trim() -> None:
    """Give freed memory back to the system: a worker may stay idle beside others for a long time."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Recent:
    """A table of the last keys that were asked for: ``size`` of them at least, and not much more than twice that."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get_all(self, keys: list) -> list:
        """What is known of each key, or None."""
        out, old = list(map(self.new.get, keys)), self.old.get
        again = {}
        for i, got in enumerate(out):
            if got is None and (got := old(keys[i])) is not None:
                out[i] = again[keys[i]] = got
        self.put_all(again)
        return out

    def put_all(self, found: dict) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new.update(found)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection in which every bit depends on all."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _P)
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """_P ** i and its inverse, for i < n."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        for k, base in enumerate((_P, U(pow(int(_P), -1, 1 << 64)))):
            table = np.full(n, base, U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


@dataclass
class Words:
    """Of consecutive documents. data: their UTF-8; start, end: of each word, in bytes; doc: each word's document;
    first: of each document its first word (one more at the end); hash: of each word."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets from 0; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def hashes(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (start, end) that hashes slices of data."""
    n = len(data)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return lambda start, end: mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each slice, one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


def words(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_BLANK[data]
    cut = np.zeros(n + 1, bool)  # a document begins here
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = np.zeros(len(starts), U)
    if hashed and n:
        h = hashes(data)(starts, ends)
    return Words(data, offsets, starts, ends, doc, first, h)


def batches_of(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(from, to, Words) for ranges of the documents."""
    data, offsets = buffers(texts)
    for at, to in chunks(data, offsets, size):
        yield at, to, words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])


def parts_of(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[Words, bool]]:
    """Words of ranges of the documents, as batches_of() has them, but a document of more than ``size`` bytes comes in
    parts of about as many, cut at blanks. True: the one document of this part goes on in the next."""
    data, offsets = buffers(texts)
    for at, to in chunks(data, offsets, size):
        low, high = int(offsets[at]), int(offsets[to])
        while high - low > size and to == at + 1:
            cut = low + size
            while cut < high:
                blanks = np.flatnonzero(_BLANK[data[cut : cut + size]])
                if len(blanks):
                    cut += int(blanks[0])
                    break
                cut = min(high, cut + size)
            if cut >= high:
                break
            yield words(data[low:cut], np.array([0, cut - low])), True
            low = cut
        yield words(data[low:high], np.maximum(offsets[at : to + 1], low) - low), False


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of n consecutive words that start at each place; the last n - 1 have none. Documents' borders are not seen."""
    if len(h) < n:
        return np.zeros(0, U)
    power, got, part = 1, None, h  # part: of `power` words
    have = 0
    base = int(_P) | 1
    left = n
    while left:
        if left & 1:
            m = len(h) - n + 1 if left == 1 else len(part)
            if got is None:
                got, have = part, power
            else:
                k = min(len(got), len(part) - have)
                got = got[:k] * U(pow(base, power, 1 << 64)) + part[have : have + k]
                have += power
        left >>= 1
        if left:
            part = part[:-power] * U(pow(base, power, 1 << 64)) + part[power:]
            power *= 2
    return mix(got[: len(h) - n + 1] + U(salt))


def whole(w: Words, n: int) -> np.ndarray:
    """For the places of grams(): does the n-gram end within its document?"""
    k = max(0, len(w.hash) - n + 1)
    return np.arange(k) + n <= w.first[1:][w.doc[:k]]


def sliding(x: np.ndarray, n: int, least: bool = True) -> np.ndarray:
    """The least (or most) of each n that follow each other."""
    f, size = np.minimum if least else np.maximum, 1
    while size * 2 <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def distinct(w: Words) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(hash, bytes) of each distinct word, and for each word which of them it is."""
    keys, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
    data = w.data.tobytes()
    return keys, [data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], which

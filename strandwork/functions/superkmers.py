"""Reads cut into super-k-mers, as arrays of whole Arrow batches.

The minimizer of a k-mer is the least hash of its m-mers. Neighbouring k-mers mostly share it; a longest run of such
k-mers is a super-k-mer, a stretch of the read from which its k-mers can be cut again. All occurrences of a k-mer have
the same minimizer, so super-k-mers are dealt by it and each k-mer is counted in one place.

Up to k = 32 they travel packed, four bases to a byte, those of a chunk that have one group as one row. Where they arrive,
in the order of their groups, windows are 64-bit integers, which are sorted and counted a few groups at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bases that are handled at once. A longer read is cut into pieces that overlap by k - 1 bases.
CHUNK = 1 << 20
#: Buckets of minimizers.
BUCKETS = 1 << 30
#: Groups of buckets by which packed super-k-mers are dealt.
GROUPS = 4096
#: Windows that are sorted at once, if their groups end.
MOST = 1 << 20
PACKED = "bucket int, sizes binary, times binary, bases binary"
#: A k-mer that occurs cnt times; or, without a k-mer, how many do, as n; or, for 0, from which cnt on k-mers are there.
COUNTED = "kmer string, cnt long, n long"
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n that follow each other."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def cut(data: np.ndarray, ends: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, start, end) of the super-k-mers of reads of digits, one after the other in data. K-mers with other
    characters than digits are in none."""
    code = data.astype(np.int16) - 48
    bad = (code < 0) | (code > 3)
    n = len(data) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    wrong = np.zeros(len(data) + 1, np.int64)
    np.cumsum(bad, out=wrong[1:])
    end = np.repeat(ends, np.diff(np.r_[0, ends]))[:n]
    whole = (wrong[k:] == wrong[:n]) & (np.arange(n) + k <= end)
    code = np.where(bad, 0, code).astype(_U)
    value = np.zeros(len(data) - m + 1, _U)
    for j in range(m):
        value = value << _U(2) | code[j : len(data) - m + 1 + j]
    least = _least(_mix(value + _U(1)), k - m + 1)
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    last = whole.copy()
    last[:-1] &= ~whole[1:] | new[1:]
    return (least[start] % _U(BUCKETS)).astype(np.int64), start, np.flatnonzero(last) + k


def _pieces(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends) of about CHUNK bases: whole reads, or a piece of a long one."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[to])
        if to > at + 1 or high - low <= CHUNK + k:
            yield data[low:high], offsets[at + 1 : to + 1] - low
        else:
            for a in range(low, high - k + 1, CHUNK):
                b = min(high, a + CHUNK + k - 1)
                yield data[a:b], np.array([b - a])
        at = to


def _reads(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        column = batch.column(0).fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        yield from _pieces(data, offsets - offsets[0], k)


def super_kmers(k: int, m: int):
    """For mapInArrow: reads (digits) to (bucket, seq, n), equal ones of a chunk counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ends in _reads(batches, k):
            bucket, start, end = cut(piece, ends, k, m)
            size = end - start
            total = np.r_[0, np.cumsum(size)]
            flat = piece[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
            seq = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(total.astype(np.int64)), pa.py_buffer(flat.tobytes()))
            table = pa.table({"bucket": bucket, "seq": seq.cast(pa.string())}).group_by(["bucket", "seq"]).aggregate([([], "count_all")])
            for part in table.rename_columns(["bucket", "seq", "n"]).combine_chunks().to_batches():
                yield part

    return run


def _values(code: np.ndarray, k: int) -> np.ndarray:
    """The value of every window of k bases, k up to 32."""
    power, size, out, have = code.astype(_U), 1, None, 0
    while True:
        if k & size:
            more = power[have:]
            out = more if out is None else out[: len(more)] << _U(2 * size) | more
            have += size
        if 2 * size > k:
            return out
        power = power[: max(0, len(power) - size)] << _U(2 * size) | power[size:]
        size *= 2


def _offsets(ends: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.r_[0, ends].astype(np.int32))


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _packed(data: np.ndarray, ends: np.ndarray, k: int, m: int) -> pa.RecordBatch | None:
    """The super-k-mers of reads as a row for each group: their numbers of windows, how often each occurs, their bases.
    Equal ones are one, but for those that two k-mers don't cover."""
    bucket, start, end = cut(data, ends, k, m)
    if not len(start):
        return None
    code = (data - 48) & 3
    value = _values(code, k)
    group, size, first, last = bucket % GROUPS, end - start, value[start], value[end - k]
    order = np.argsort(group.astype(_U) << _U(52) | _mix(first ^ _mix(last + size.astype(_U))) >> _U(12))
    group, size, first, last, start = group[order], size[order], first[order], last[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (size[1:] != size[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (size[1:] > 2 * k)
    kept = np.flatnonzero(new)
    times = np.diff(np.r_[kept, len(order)])
    group, size, start = group[kept], size[kept], start[kept]
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    tail = np.r_[head[1:], len(group)]
    total = np.add.reduceat(size, head)
    places = np.cumsum(-(-total // 4))  # a group begins with a byte
    before = np.cumsum(size) - size
    to = before + np.repeat(4 * (places + -total // 4) - before[head], tail - head)
    bases = np.zeros(4 * places[-1], np.uint8)
    bases[_flat(to, size)] = code[_flat(start, size)]
    bases = bases.reshape(-1, 4)
    bases = bases[:, 0] << 6 | bases[:, 1] << 4 | bases[:, 2] << 2 | bases[:, 3]
    blob = lambda x, ends: pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, _offsets(ends), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays(
        [pa.array(group[head].astype(np.int32)), blob((size - k + 1).astype(np.int32), 4 * tail), blob(times.astype(np.int32), 4 * tail), blob(bases, places)], names=["bucket", "sizes", "times", "bases"]
    )


def packed_super_kmers(k: int, m: int):
    """For mapInArrow: reads (digits) to PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ends in _reads(batches, k):
            if (made := _packed(piece, ends, k, m)) is not None:
                yield made

    return run


def _blobs(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values, the first of each row and the end)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


_FOUR = np.stack([np.arange(256) >> s & 3 for s in (6, 4, 2, 0)], 1).astype(np.uint8)
_TEXT = np.ascontiguousarray(_FOUR + 48).view(np.uint32)[:, 0]


def _windows(rows: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, times) of the windows of rows of PACKED."""
    sizes, at = _blobs(rows.column(1), np.int32)
    times, _ = _blobs(rows.column(2), np.int32)
    bases, place = _blobs(rows.column(3), np.uint8)
    sizes = sizes.astype(np.int64)
    before = np.cumsum(sizes + k - 1) - (sizes + k - 1)
    start = before + np.repeat(4 * place[:-1] - before[at[:-1]], np.diff(at))
    return _values(_FOUR[bases].ravel(), k)[_flat(start, sizes)], np.repeat(times.astype(np.int64), sizes)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(value, times) of distinct values."""
    value, times = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(value)
    value = value[order]
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    return value[head], np.add.reduceat(times[order], head)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows of about MOST bases that end where a group does, or, if it is larger, within it; and whether they go on with
    the group of those before."""
    last = None
    for batch in batches:
        bucket, a = batch.column(0).to_numpy(), 0
        ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
        size = 4 * _blobs(batch.column(3), np.uint8)[1]
        while a < len(bucket):
            most = max(a + 1, int(np.searchsorted(size, size[a] + MOST, "right")) - 1)
            whole = ends[(ends > a) & (ends <= most)]
            on = bucket[a] == last
            b = most if not len(whole) else int(whole[0] if on else whole[-1])
            yield batch.slice(a, b - a), on
            a, last = b, bucket[b - 1]


def _floor(each: np.ndarray) -> int:
    """What the cutoff of all tasks won't be under, as far as the histogram of a part of one tells: the first bucket that has
    at most twice as many k-mers as the one with fewest, and 100."""
    return 1 + int(np.argmax(each[1:] <= 2 * each[1:].min() + 100))


def counted(k: int, least: int | None, buckets: int = 0):
    """For mapInArrow on PACKED, in the order of bucket: COUNTED, k-mers that occur least times or more; and how many k-mers
    occur exactly so often, for each number under buckets, of all k-mers. If least is None, it is taken from the first
    ones that are counted."""

    def text(value: np.ndarray, cnt: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(value), 1 << 16):
            v, c = value[i : i + (1 << 16)], cnt[i : i + (1 << 16)]
            digits = np.ascontiguousarray(_TEXT[v.byteswap().view(np.uint8)].view(np.uint8).reshape(-1, 32)[:, 32 - k :])
            kmer = pa.StringArray.from_buffers(len(v), _offsets(np.arange(1, len(v) + 1) * k), pa.py_buffer(digits))
            yield pa.RecordBatch.from_arrays([kmer, pa.array(c), pa.array(np.ones(len(v), np.int64))], names=["kmer", "cnt", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, held, size, most, floor = np.zeros(buckets, np.int64), [], 0, 4 * MOST, least

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal floor
            value, cnt = _summed(held)
            each[:] += np.bincount(cnt[cnt < buckets], minlength=buckets)
            floor = _floor(each) if floor is None else floor
            yield from text(value[cnt >= floor], cnt[cnt >= floor])

        for rows, on in _stretches(batch for batch in batches if len(batch)):
            if size >= MOST and not on:
                yield from done()
                held, size, most = [], 0, 4 * MOST
            held.append(_windows(rows, k))
            size += len(held[-1][0])
            if size >= most:  # of a large group, the distinct ones
                held = [_summed(held)]
                size = len(held[0][0])
                most = max(most, 2 * size)
        if held:
            yield from done()
        if buckets and floor is not None:
            each[0] = floor
            yield pa.RecordBatch.from_arrays([pa.nulls(buckets, pa.string()), pa.array(np.arange(buckets)), pa.array(each)], names=["kmer", "cnt", "n"])

    return run

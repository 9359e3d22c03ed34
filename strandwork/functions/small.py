"""What a graph that is small by now is left to: one task that holds all of it, for mapInArrow. On such a graph a join
costs what starting it does, and rounds and steps are many. How small, callers measure; larger graphs go on as joins.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes of text of an Arrow batch that is made here.
ROWS, BYTES = 10_000, 4 << 20

NODE_EXT = "node string, side string, ext string, terminal boolean, cnt long, visit long, ext_id int"
#: kind 0: node_ext; 1: a partial contig, as ext; 2: a round, its nodes as cnt, chosen as visit, messages and seconds.
ROUNDS = f"kind int, {NODE_EXT}, messages long, seconds double"
_NODE_EXT = [("node", pa.string()), ("side", pa.string()), ("ext", pa.string()), ("terminal", pa.bool_()), ("cnt", pa.int64()), ("visit", pa.int64()), ("ext_id", pa.int32())]
_ROUNDS = pa.schema([("kind", pa.int32()), *_NODE_EXT, ("messages", pa.int64()), ("seconds", pa.float64())])
_CONTIG = pa.schema([("contig", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """rows as batches; text is the place of the column that may be long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "")
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, ROWS).columns], strict=True)


# A row of node_ext inside a node's side: (ext, terminal, cnt, visit), in the order of ext_id.
_BY_ID = lambda r: (r[1], r[0], -r[3], -r[2])


def _placed(rows: list[tuple]) -> list[tuple]:
    """(lo, hi, row) of the rows of a side, as wiring.intervals orders them."""
    out, lo = [], 0
    for _, r in sorted(((i, r) for i, r in enumerate(rows) if r[3] > 0), key=lambda x: (-x[1][3], -x[1][2], x[1][1], len(x[1][0]), x[1][0], x[0])):
        out.append((lo, lo + r[3], r))
        lo += r[3]
    return out


def wires(prefixes: list[tuple], suffixes: list[tuple]) -> Iterator[tuple[tuple, tuple, int]]:
    """(prefix, suffix, visits) where intervals of both sides overlap."""
    p, s = _placed(prefixes), _placed(suffixes)
    i = j = 0
    while i < len(p) and j < len(s):
        n = min(p[i][1], s[j][1]) - max(p[i][0], s[j][0])
        if n > 0:
            yield p[i][2], s[j][2], n
        if p[i][1] <= s[j][1]:
            i += 1
        else:
            j += 1


def one_round(graph: dict[str, tuple[list, list]], k: int) -> tuple[list[str], int, list[str]]:
    """Compacts graph (node: prefixes, suffixes) by a round; (chosen nodes, number of messages, partial contigs)."""
    m = k - 1
    before = lambda node, ext: ((ext + node)[:m], (ext + node)[m:])
    after = lambda node, ext: ((node + ext)[-m:], (node + ext)[:-m])
    chosen = []
    for node, (prefixes, suffixes) in graph.items():
        if all(r[1] or before(node, r[0])[0] <= node for r in prefixes) and all(r[1] or after(node, r[0])[0] <= node for r in suffixes):
            chosen.append(node)
    contigs, named, new, sent = [], set(), defaultdict(lambda: ([], [])), 0
    for node in chosen:
        for (p_ext, p_end, p_cnt, _), (s_ext, s_end, s_cnt, _), n in wires(*graph[node]):
            if p_end and s_end:
                contigs.append(p_ext + node + s_ext)
                continue
            p_to, p_back = (None, None) if p_end else before(node, p_ext)
            s_to, s_back = (None, None) if s_end else after(node, s_ext)
            cnt = min(p_cnt, s_cnt)
            if not p_end and p_to != node:
                named.add((p_to, 1, p_back))
                new[p_to][1].append((p_back + s_ext, s_end or s_to == node, cnt, n))
                sent += 1
            if not s_end and s_to != node:
                named.add((s_to, 0, s_back))
                new[s_to][0].append((p_ext + s_back, p_end or p_to == node, cnt, n))
                sent += 1
    for node in chosen:
        del graph[node]
    for node, side, ext in named:
        rows = graph[node][side] if node in graph else []
        at = next((i for i, r in enumerate(rows) if r[0] == ext and not r[1]), None)
        if at is not None:
            del rows[at]
    for node, sides in new.items():
        kept = graph.setdefault(node, ([], []))
        for rows, more in zip(kept, sides, strict=True):
            rows.extend(more)
            rows.sort(key=_BY_ID)
    return chosen, sent, contigs


def rounds(k: int, n: int, threshold: int, most: int | None, rows_most: int, text_most: int):
    """For mapInArrow on all of node_ext in one partition: rounds until at most threshold of n nodes are left, most rounds
    are made, or the graph has more rows or text than it may; at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: ([], []))
        for node, side, ext, terminal, cnt, visit, ext_id in _rows(batches):
            held[node][side == "S"].append((ext_id, (ext, terminal, cnt, visit)))
        graph = {node: tuple([r for _, r in sorted(side)] for side in sides) for node, sides in held.items()}
        held.clear()
        if graph:
            yield from _batches(_made(graph), _ROUNDS, 3)

    def _made(graph: dict) -> Iterator[tuple]:
        left, made = n, 0
        while left > threshold and (most is None or made < most):
            began = time.monotonic()
            chosen, sent, contigs = one_round(graph, k)
            for contig in contigs:
                yield 1, None, None, contig, None, None, None, None, None, None
            if not made:  # as a graph was built, its null extensions come first
                for sides in graph.values():
                    for rows in sides:
                        rows.sort(key=_BY_ID)
            made += 1
            yield 2, None, None, None, None, left, len(chosen), made, sent, time.monotonic() - began
            left -= len(chosen)
            if sum(len(a) + len(b) for a, b in graph.values()) > rows_most or sum(len(r[0]) for sides in graph.values() for rows in sides for r in rows) > text_most:
                break
        for node, sides in graph.items():
            for name, rows in zip("PS", sides, strict=True):
                for i, r in enumerate(rows):
                    yield 0, node, name, *r, i, None, None

    return run


def walks(mode: str, most: int):
    """For mapInArrow on all edges in one partition, and a row with its text as s_ext and a null start for each place
    where walks begin: (contig) of the walks that end, one after the other. A contig of most bases is an error, and so is a
    walk of ten times that which hasn't ended: it goes in a circle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways, begins = defaultdict(list), []  # an edge holds the list of those it leads to
        for node, p_id, start, size, off_s, s_ext, done, next_node, next_p in _rows(batches):
            if start is None:
                begins.append((ways[node, p_id], size, s_ext))
            else:
                ways[node, p_id].append((start, size, off_s, s_ext, done, () if done else ways[next_node, next_p]))
        ways.clear()
        yield from _batches(_walked(begins), _CONTIG, 0)

    def _walked(begins: list) -> Iterator[tuple]:
        for to, freq, text in begins:
            path, lengths, stack = [], [], [(0, text, False, to, 0, freq)]
            while stack:
                depth, text, done, to, off, freq = stack.pop()
                del path[depth:], lengths[depth:]
                path.append(text)
                lengths.append(len(text) + (lengths[-1] if lengths else 0))
                if lengths[-1] >= (most if done else 10 * most):
                    raise ValueError("a contig grew too long")
                if done:
                    yield ("".join(path),)
                    continue
                for start, size, off_s, s_ext, ends, next_to in to:
                    at = max(off, start)
                    n = min(off + freq, start + size) - at
                    if n > 0 and (mode == "full" or start <= off or 2 * (start - off) <= freq):
                        stack.append((depth + 1, s_ext, ends, next_to, off_s + at - start, n))

    return run

"""Operator 10: substring dedup by relative Lempel-Ziv parsing.

The reference that documents are parsed against is every earlier document, indexed by the hashes of all its
windows of ``window`` words and dealt in blocks by hash, so that each document meets every block and no block is
larger than others for a passage that many documents hold. The index gives each window of a document that starts in an
earlier one too its first place there. A document is parsed greedily from left to right: a factor (start, length,
document, place in it) goes on while the next window's place is the next one in the same document, so each factor stands
word for word in its document. Where it ends, and across the border to the next factor, every window has been looked up
on its own. So factors, taken together, cover exactly the words of windows that also start in a document with a smaller
id. The parse is greedy among first places; a longer match that begins at a later place isn't looked for, as it would
cover the same words.

To index every window of every text would move several times the input. Two facts keep it small:
- Equal windows have equal minimizers (of the hashes of their ANCHOR-word grams the least). Minimizers are about a
  fifth of all places, and only windows whose minimizer occurs in two documents can repeat.
- Of the occurrences that one batch of documents holds, only those of its first document are sent; the others are
  decided where they are. A passage in a third of all documents thus costs one row per batch, not per document.

Cases: a null or empty text has no words; texts shorter than a window lose nothing; a very long text is one row, parsed
in arrays; documents with equal ids don't repeat each other, however many there are, and are told apart by 64 bits of
hash of their texts; rows equal in both have equal results; a null id comes after all others; of several places of a
window in its first document the first is taken; an empty table gives an empty result; of other columns, whatever their
names, nothing is read. Windows are compared by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

WINDOW = 13
ANCHOR = 5
_LAST = (1 << 63) - 1
#: Ids that several rows have are broadcast up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 200_000
_MOST = np.uint64((1 << 64) - 1)

#: key: what must meet; doc, tk: the document (tk, the hash of its text, tells apart rows with equal ids); pos: the word; more: other places
#: of the key in the document; local: places that were decided in the batch.
_ROWS = "key long, doc long, tk long, pos int, more binary, local binary"
#: Bytes of text whose occurrences are decided together.
GATHER = 1 << 24


def anchor_places(w: K.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, whole windows, minimum of each window, the anchors' places)."""
    x = K.grams(w.hash, anchor) >> K.U(1) | K.U(1)
    if len(w.hash) < window:
        return x, np.zeros(0, bool), np.zeros(0, K.U), np.zeros(0, np.int64)
    full = K.whole(w, window)
    least = K.sliding(x, window - anchor + 1)
    reach = np.where(full, least, K.U(0))
    pad = np.zeros(window - anchor, K.U)
    most = K.sliding(np.concatenate([pad, reach, pad]), window - anchor + 1, least=False)
    return x, full, least, np.flatnonzero(most == x)


#: A run, packed: start, number, place in the document, document.
_RUN = np.dtype([("start", "<i4"), ("n", "<i4"), ("at", "<i4"), ("ref", "<i8")])


def _edges(pos: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a run begins: places that follow each other, as their places in the same document do; pos rises."""
    return np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1)])


def as_runs(pos: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of places."""
    edge = _edges(pos, ref, at)
    runs = np.empty(len(edge), _RUN)
    runs["start"], runs["n"], runs["at"], runs["ref"] = pos[edge], np.diff(np.r_[edge, len(pos)]), at[edge], ref[edge]
    return runs


def from_runs(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = runs["n"].astype(np.int64)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(runs["start"], n) + inner, np.repeat(runs["ref"], n), np.repeat(runs["at"], n) + inner


def _split(key: np.ndarray, doc: np.ndarray, tk: np.ndarray, pos: np.ndarray, refs: bool) -> pa.RecordBatch:
    """One row for each key, of the first document that has it. What is decided here is packed: with refs the
    places in later documents (runs), else all places of keys that two documents share."""
    order = np.lexsort((pos, tk, doc, key))
    key, doc, tk, pos = key[order], doc[order], tk[order], pos[order]
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first, place = (doc[at][group], pos[at][group]) if n else (doc, pos)
    later = doc > first
    shared = later if refs or not n else np.logical_or.reduceat(later, at)[group]
    send = ~later & (refs | ~shared | new)
    key, sd, st, sp = key[send], doc[send], tk[send], pos[send]
    head = np.ones(len(key), bool)  # one row for the places of a key in a document
    head[1:] = (key[1:] != key[:-1]) | (sd[1:] != sd[:-1]) | (st[1:] != st[:-1])
    heads = np.flatnonzero(head)
    size = np.diff(np.r_[heads, len(key)])
    more = np.full(len(heads), None, object)
    for i in np.flatnonzero(size > 1).tolist():
        more[i] = sp[heads[i] + 1 : heads[i] + size[i]].astype(np.int32).tobytes()
    packed: dict[tuple[int, int], bytes] = {}
    if shared.any():
        d, t, p, r, q = doc[shared], tk[shared], pos[shared], first[shared], place[shared]
        by = np.lexsort((p, t, d))
        d, t, p, r, q = d[by], t[by], p[by], r[by], q[by]
        edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        for a, b in zip(edge.tolist(), np.r_[edge[1:], len(d)].tolist(), strict=True):
            packed[int(d[a]), int(t[a])] = as_runs(p[a:b], r[a:b], q[a:b]).tobytes() if refs else p[a:b].astype(np.int32).tobytes()
    m = len(packed)
    docs, tks = np.array([x for x, _ in packed], np.int64), np.array([x for _, x in packed], np.int64)
    spread = K.mix(docs.view(K.U) ^ tks.view(K.U)).view(np.int64)
    return pa.record_batch(
        [
            pa.array(np.concatenate([key[heads].view(np.int64), spread])),
            pa.array(np.concatenate([sd[heads], docs])),
            pa.array(np.concatenate([st[heads], tks])),
            pa.array(np.concatenate([sp[heads], np.full(m, -1)]).astype(np.int32)),
            pa.array([*more, *[None] * m], pa.binary()),
            pa.array([None] * len(heads) + list(packed.values()), pa.binary()),
        ],
        names=["key", "doc", "tk", "pos", "more", "local"],
    )


def _gathered(parts: Iterator[tuple[int, tuple[np.ndarray, ...]]], refs: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (bytes, (key, doc, tk, pos)), decided GATHER bytes at a time."""
    held, size = [], 0
    for n, part in parts:
        held.append(part)
        size += n
        if size >= GATHER:
            yield _split(*(np.concatenate(x) for x in zip(*held, strict=True)), refs)
            held, size = [], 0
    if held:
        yield _split(*(np.concatenate(x) for x in zip(*held, strict=True)), refs)


def _identity(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch["doc"].to_numpy(zero_copy_only=False).astype(np.int64), batch["tk"].to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(window: int, anchor: int):
    def places_of(batch: pa.RecordBatch):
        doc, tk = _identity(batch)
        for a, _, w in K.batches_of(batch["text"]):
            x, _, _, places = anchor_places(w, window, anchor)
            of = w.doc[places]
            yield len(w.data), (x[places], doc[a + of], tk[a + of], places - w.first[of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _gathered(places_of(batch), False)
        K.trim()

    return run


def _windows(window: int, anchor: int):
    def places_of(batch: pa.RecordBatch):
        doc, tk = _identity(batch)
        places, packed = batch["places"].to_pylist(), batch["packed"].to_pylist()
        for a, b, w in K.batches_of(batch["text"]):
            x, full, least, _ = anchor_places(w, window, anchor)
            if not len(full):
                continue
            held = np.full(len(x), _MOST)
            for i in range(a, b):
                at = np.concatenate([np.array(places[i], np.int64), *(np.frombuffer(y, np.int32).astype(np.int64) for y in packed[i])])
                at += w.first[i - a]
                held[at] = x[at]
            may = np.flatnonzero(full & (K.sliding(held, window - anchor + 1) == least))
            of = w.doc[may]
            yield len(w.data), (K.grams(w.hash, window)[may], doc[a + of], tk[a + of], may - w.first[of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _gathered(places_of(batch), True)
        K.trim()

    return run


def documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, tk, text): tk is 0 where doc_id is unique, as it mostly is (then it costs nothing to carry along), else the
    64-bit hash of the text."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))
    same = C.cut(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc").alias("_same")))
    same = F.broadcast(same) if same.count() <= BROADCAST_IDS else same
    tk = F.when(F.col("_same").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    return rows.join(same, F.col("doc") == F.col("_same"), "left").select("doc", tk.alias("tk"), "text")


def repeated_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, tk, pos, ref, more, runs) of documents(): of each document with any, its windows that also start in a
    document before it: places and, in the same order, refs; other places, packed, with ref; and runs decided in a batch.
    ref: the earliest document that was seen with the window, and its first place there."""
    sent = rows.mapInArrow(_anchors(window, anchor), _ROWS)
    met = Window.partitionBy("key")
    sent = sent.withColumn("shared", F.min("doc").over(met) < F.max("doc").over(met)).where("shared OR local IS NOT NULL")
    own = F.col("local").isNull()
    by_doc = C.cut(sent.groupBy("doc", "tk").agg(F.collect_list(F.when(own, F.col("pos"))).alias("places"), F.collect_list(F.coalesce("local", "more")).alias("packed")), free=True)
    todo = rows.join(by_doc, ["doc", "tk"]).mapInArrow(_windows(window, anchor), _ROWS)
    todo = todo.withColumn("ref", F.min(F.struct("doc", "pos")).over(met)).where("ref.doc < doc OR local IS NOT NULL")
    other = F.when(F.col("more").isNotNull(), F.struct("more", "ref"))
    return todo.groupBy("doc", "tk").agg(F.collect_list(F.when(own, F.col("pos"))).alias("pos"), F.collect_list(F.when(own, F.col("ref"))).alias("ref"), F.collect_list(other).alias("more"), F.collect_list("local").alias("runs"))


def factors(pos: np.ndarray, ref: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The greedy factors (start, length, document, place in it) of repeated windows in the order of their places."""
    return [(start, n + window - 1, doc, place) for start, n, place, doc in as_runs(pos, ref, at).tolist()] if len(pos) else []


def _as_spans(window: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            flat_pos, refs = batch["pos"].flatten().to_numpy().astype(np.int64), batch["ref"].flatten()
            flat_ref, flat_at = refs.field("doc").to_numpy(), refs.field("pos").to_numpy().astype(np.int64)
            edge = np.r_[0, np.cumsum(batch["pos"].value_lengths())]
            for i, (more, runs) in enumerate(zip(*(batch[c].to_pylist() for c in ("more", "runs")), strict=True)):
                here = slice(edge[i], edge[i + 1])
                parts = [(flat_pos[here], flat_ref[here], flat_at[here])]
                for x in more:
                    p = np.frombuffer(x["more"], np.int32).astype(np.int64)
                    parts.append((p, np.full(len(p), x["ref"]["doc"]), np.full(len(p), x["ref"]["pos"])))
                parts += [from_runs(np.frombuffer(x, _RUN)) for x in runs]
                p, r, q = (np.concatenate(x) for x in zip(*parts, strict=True))
                by = np.lexsort((q, r, p))
                by = by[np.r_[True, p[by][1:] != p[by][:-1]]]
                out.append([{"start": a, "len": n, "ref": x, "ref_start": y} for a, n, x, y in factors(p[by], r[by], q[by], window)])
            yield pa.record_batch([batch["doc"], batch["tk"], pa.array(out, kind)], names=["doc", "tk", "spans"])
        K.trim()

    return run


def _spans(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    return repeated_windows(rows, window, anchor).mapInArrow(_as_spans(window), "doc long, tk long, spans array<struct<start:int,len:int,ref:long,ref_start:int>>")


def duplicate_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, tk, spans): for each document with any, its factors as (start, len) in words, and where they stand: the
    earlier document and the word there."""
    return _spans(documents(docs, text, doc_id), window, anchor)


def kept_bytes(w: K.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words with one space after each, and where each document's begin."""
    n = len(w.data)
    change = np.zeros(n + 1, np.int8)
    keep = ~gone
    change[w.start[keep]] = 1
    change[w.end[keep]] -= 1
    mask = np.cumsum(change[:n], dtype=np.int8).view(bool) if n else np.zeros(0, bool)
    data = w.data
    after = w.end[keep]
    after = after[after < w.offsets[w.doc[keep] + 1]]  # the byte after a text's last word is another text's
    data = data.copy()
    data[after] = 32
    mask[after] = True
    at = np.zeros(n + 1, np.int64)
    np.cumsum(mask, out=at[1:])
    return data[mask], at[w.offsets]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch["spans"]
        counts, removed, sha = [], [], []
        starts, lens = spans.flatten().field("start").to_numpy(), spans.flatten().field("len").to_numpy()
        per = np.asarray(spans.value_lengths().fill_null(0))
        edges = np.r_[0, np.cumsum(per)]
        for a, b, w in K.batches_of(batch["text"]):
            change = np.zeros(len(w.start) + 1, np.int32)
            base = np.repeat(w.first[:-1], per[a:b])
            s, n = starts[edges[a] : edges[b]] + base, lens[edges[a] : edges[b]]
            np.add.at(change, s, 1)
            np.add.at(change, s + n, -1)
            gone = np.cumsum(change[:-1]) > 0
            data, at = kept_bytes(w, gone)
            for i in range(b - a):
                piece = data[at[i] : at[i + 1]].tobytes()
                sha.append(hashlib.sha256(piece[:-1] if piece.endswith(b" ") else piece).hexdigest())
            counts.append(np.diff(w.first))
            total = np.r_[0, np.cumsum(gone)]
            removed.append(total[w.first[1:]] - total[w.first[:-1]])
        if sha:
            yield pa.record_batch(
                [batch["doc_id"], pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(removed).astype(np.int64)), pa.array(sha)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def query(spark, sf_dir: str) -> DataFrame:
    rows = documents(C.table(spark, sf_dir, "documents"))
    spans = C.cut(_spans(rows, WINDOW, ANCHOR), free=True).withColumnsRenamed({"doc": "_doc", "tk": "_tk"})
    both = rows.join(spans, (rows["doc"] == spans["_doc"]) & (rows["tk"] == spans["_tk"]), "left")
    both = both.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "text", "spans")
    return both.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM starts
), firsts AS (
  SELECT g, min(doc_id) AS doc_id FROM grams GROUP BY g
), hits AS (
  SELECT grams.doc_id, grams.i FROM grams JOIN firsts ON grams.g = firsts.g WHERE firsts.doc_id < grams.doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM hits)
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS t, count(*) AS n
  FROM placed p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i WHERE gone.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

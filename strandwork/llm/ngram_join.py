"""Operator 4: n-gram Jaccard join by a MinHash LSH forest, verified exactly.

A document is its set of NGRAM-word shingles (a text with fewer words: all of them as one). Each of TREES prefix
tries holds signatures of up to DEPTH minima; documents that share a prefix are a group. Matching begins at whole
signatures and shortens the prefix until a pair at the threshold shares SHARED tries with probability RECALL. At each
depth only groups that still hold two classes are looked at: documents whose class is settled by a long prefix aren't
matched by shorter ones.

No step lists or compares all pairs of a group. Documents with equal shingles are one node. In a group each node is
verified against the group's first; what is linked is a class from then on. What is left are nodes that share SHARED
groups with nodes of other classes. Of their shingles only those that two classes have (mixed ones) can be part of such a
link. With all shingles ordered alike, those that aren't mixed first, then the rarer before the more frequent, two sets
as similar as the threshold have their first common shingle within a short prefix of either, and enough of both behind
it; so nodes meet by single shingles of their prefixes, and only pairs that can still reach the threshold are handed on
to be verified. Pages that are one template with a word or two of their own, and so are a little less similar than that,
have their own shingles first and don't meet at all.

Every link between different texts, but for 1 - RECALL of those right at the threshold, either is in the result or joins
two texts of one class. Jaccard is computed from the texts' shingles (64-bit hashes), members of a first text in blocks
of BLOCK, so a group of any size is spread over many tasks.

Links are counted after that, when classes are known: a link never leaves a class, so all pairs inside each class are
verified. A class is dealt in blocks of about PAIRED texts, and each two blocks meet in a task that hands on a number
for each text, not the pairs. The work grows with the square of a class, and so do the rows: n / PAIRED for each text.

Result: a row for each document: class_id, the least doc_id of its class; n_links, the different texts that are
similar to its own; n_copies, the documents with equal shingles.

Cases: texts without a word, or null, are linked to nothing, each is its own class; a very long text is one set of
shingles, in one task; a null doc_id comes after all others, rows with equal ids are told apart by 64 bits of their
texts' hash; rows that repeat are copies; of equally small ids in a class the first by that hash stands for it; an empty
table gives an empty result; of other columns, whatever their names, the query reads nothing and one_of_each() hands all
on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K
from .components import components

NGRAM = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 6
STEP = 2
#: Tries in which a pair has to share a prefix, and with what probability one at the threshold does.
SHARED = 2
RECALL = 0.9999
BLOCK = 256
#: Shingles before one in a prefix that are looked at to hand a pair on once.
SEEN = 64
#: Texts of a block in which a class is dealt to count its links; it is smaller if its texts have more than SHINGLES.
PAIRED = 128
SHINGLES = 1 << 21
#: Different shingles that are looked at together.
COLUMNS = 4096
_LAST = (1 << 63) - 1


def recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """How likely a pair at the threshold shares prefixes of this depth in SHARED tries or more."""
    p = threshold**depth
    return 1 - sum(math.comb(trees, i) * p**i * (1 - p) ** (trees - i) for i in range(SHARED))


def depths(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, step: int = STEP, least: float = RECALL) -> list[int]:
    """From the whole signature to the first prefix that finds enough."""
    out = [depth]
    while recall(threshold, out[-1], trees) < least and out[-1] > 1:
        out.append(max(1, out[-1] - step))
    return out


def shingles(w: K.Words, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the documents, one after the other, and where each document's begin (with an end)."""
    g = K.grams(w.hash, ngram)
    full = np.zeros(len(w.hash), bool)
    full[: len(g)] = K.whole(w, ngram)
    values = np.zeros(len(w.hash), K.U)
    values[: len(g)] = g
    few = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < ngram))
    for d in few.tolist():  # all words as one
        a, b = int(w.first[d]), int(w.first[d + 1])
        values[a] = K.grams(w.hash[a:b], b - a, salt=1)[0]
        full[a] = True
    at = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=at[1:])
    return values[full], at[w.first]


def _signatures(ngram: int, trees: int, depth: int, used: list[int]):
    n = trees * depth
    a = (K.mix(np.arange(1, n + 1, dtype=K.U)) >> K.U(32)).astype(np.uint32) | np.uint32(1)
    b = K.mix(np.arange(n + 1, 2 * n + 1, dtype=K.U)).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in K.batches_of(batch["text"]):
                g, first = shingles(w, ngram)
                has = np.flatnonzero(np.diff(first) > 0)
                if not len(has):
                    continue
                start = first[has]
                low = (g >> K.U(32)).astype(np.uint32)
                least = np.empty((n, len(has)), np.uint32)
                for i in range(n):
                    least[i] = np.minimum.reduceat(low * a[i] + b[i], start)
                node = K.mix(np.add.reduceat(K.mix(g), start) + np.diff(first)[has].astype(K.U))
                keys = []
                for t in range(trees):
                    h = K.mix(np.full(len(has), t + 1, K.U))
                    for d in range(depth):
                        h = K.mix(h ^ least[t * depth + d].astype(K.U))
                        if d + 1 in used:
                            keys.append(h.view(np.int64))
                keys_list = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(keys, 1).ravel()), len(keys)).cast(pa.list_(pa.int64()))
                yield pa.record_batch(
                    [batch["doc"].take(pa.array(at + has)), batch["tk"].take(pa.array(at + has)), pa.array(node.view(np.int64)), keys_list, pa.array(np.diff(first)[has].astype(np.int64))],
                    names=["doc", "tk", "node", "keys", "size"],
                )
        K.trim()

    return run


def _documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("tk"), F.col(text).alias("text"))


def _jaccard(ngram: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            firsts, blocks, nodes = (batch[c].to_pylist() for c in ("first", "block", "node"))
            a_, b_ = [], []
            for at, to, w in K.batches_of(batch["text"]):
                g, begin = shingles(w, ngram)
                for i in range(at, to):
                    mine = np.unique(g[begin[i - at] : begin[i - at + 1]])
                    if nodes[i] == firsts[i]:
                        key, own = (firsts[i], blocks[i]), mine
                        continue
                    assert key == (firsts[i], blocks[i])
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if both + 1e-9 >= threshold * (len(own) + len(mine) - both):
                        a_.append(firsts[i])
                        b_.append(nodes[i])
            yield pa.record_batch([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])
        K.trim()

    return run


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """The pairs (a, b, n) of nodes whose Jaccard is at least the threshold. n: the size of the group that a pair
    comes from; by it, partners of an a are dealt in blocks, each with a's text before them."""
    pairs = C.cut(pairs.groupBy("a", "b").agg(F.max("n").alias("n")))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    asked = dealt.select(F.col("a").alias("first"), "block", F.col("b").alias("node"), F.lit(1).alias("role"))
    asked = asked.unionByName(asked.select("first", "block", F.col("first").alias("node"), F.lit(0).alias("role")).distinct())
    texts = asked.join(nodes.select("node", "doc", "tk"), "node").join(rows, ["doc", "tk"]).select("first", "block", "role", "node", "text")
    spread = texts.repartition(F.col("first"), F.col("block")).sortWithinPartitions("first", "block", "role")
    found = C.cut(spread.mapInArrow(_jaccard(ngram, threshold), "a long, b long").distinct(), free=True)
    C.drop(pairs)
    return found


def _sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in K.batches_of(batch["text"]):
                g, first = shingles(w, ngram)
                sets = [np.unique(g[a:b]).view(np.int64) for a, b in zip(first.tolist(), first[1:].tolist())]
                edge = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(sets)))
                yield pa.record_batch([batch["node"].slice(at, to - at), batch["comp"].slice(at, to - at), tokens], names=["node", "comp", "tokens"])
        K.trim()

    return run


def crossing(open_nodes: DataFrame, rows: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(a, b): a table of pairs of these nodes (node, doc, tk, comp) of different classes that may be similar, by an exact
    bound."""
    texts = open_nodes.select("node", "comp", "doc", "tk").join(rows, ["doc", "tk"]).dropDuplicates(["node"]).select("node", "comp", "text")
    sets = C.cut(texts.mapInArrow(_sets(ngram), "node long, comp long, tokens array<long>"))
    each = sets.select("node", "comp", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    mixed = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("token", "n")
    own = Window.partitionBy("node")
    most = lambda part: F.ceil(F.col("size") * F.lit(part) - 1e-9)
    held = each.join(mixed, "token").withColumn("_mixed", F.count(F.lit(1)).over(own)).where(F.col("_mixed") >= most(threshold))
    placed = held.withColumn("pos", F.col("size") - F.col("_mixed") + F.row_number().over(own.orderBy("n", "token")))
    placed = placed.where(F.col("pos") <= F.col("size") - most(threshold) + 1).select("node", "comp", "size", "token", "pos")
    # A pair is handed on at its first common shingle; the bounds hold there if they hold at a later one.
    placed = C.cut(placed.withColumn("before", F.collect_list("token").over(own.orderBy("pos").rowsBetween(-SEEN, -1))))
    short = placed.where(F.col("pos") <= F.col("size") - most(2 * threshold / (1 + threshold)) + 1).select(F.col("token").alias("_token"), *[F.col(c).alias(f"_{c}") for c in ("node", "comp", "size", "pos", "before")])
    smaller = (F.col("_size") < F.col("size")) | (F.col("_size") == F.col("size")) & (F.col("_node") < F.col("node"))
    needed = F.ceil((F.col("size") + F.col("_size")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    reach = F.least(F.col("size") - F.col("pos"), F.col("_size") - F.col("_pos")) + 1
    near = (F.col("token") == F.col("_token")) & (F.col("comp") != F.col("_comp")) & smaller & (F.col("_size") >= F.col("size") * F.lit(threshold) - 1e-9) & (reach >= needed) & ~F.arrays_overlap("before", "_before")
    pairs = C.cut(placed.join(short, near).select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct(), free=True)
    C.drop(sets, placed)
    return pairs


def _with_classes(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open_groups(members: DataFrame) -> DataFrame:
    """The groups that hold two classes, their size and their first node."""
    first = F.min(F.struct("doc", "node", "comp")).alias("first")
    return members.groupBy("key").agg(first, F.count(F.lit(1)).alias("n"), F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("key", "n", "first")


def links_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ngram: int = NGRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, links): (doc, tk, node); (node, doc, tk, size, n_copies, comp); (a, b), linked nodes, enough
    of them to span each class."""
    C.small_batches(docs.sparkSession)
    rows = _documents(docs, text, doc_id)
    used = depths(threshold)
    signed = C.cut(rows.mapInArrow(_signatures(ngram, TREES, DEPTH, used), "doc long, tk long, node long, keys array<long>, size long"))
    first = F.min(F.struct("doc", "tk", "keys", "size")).alias("s")
    nodes = C.cut(signed.groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"), first).select("node", "n_copies", "s.*"))
    per_tree = sorted(used)
    links: DataFrame | None = None
    for k in used:
        classed = C.cut(_with_classes(nodes, links).drop("keys").join(nodes.select("node", _keys(k, per_tree).alias("keys")), "node"))
        members = classed.select("node", "doc", "comp", F.explode("keys").alias("key"))
        groups = _open_groups(members)
        pairs = members.join(groups, "key").where(F.col("comp") != F.col("first.comp")).select(F.col("first.node").alias("a"), F.col("node").alias("b"), "n")
        found = verified(pairs, nodes, rows, ngram, threshold)
        links = found if links is None else C.cut(links.unionByName(found))
        C.drop(classed)
    classed = C.cut(_with_classes(nodes, links).drop("keys").join(nodes.select("node", _keys(used[-1], per_tree).alias("keys")), "node"))
    members = classed.select("node", "doc", "comp", F.explode("keys").alias("key"))
    shared = members.join(_open_groups(members).select("key"), "key").groupBy("node").agg(F.count(F.lit(1)).alias("_shared")).where(F.col("_shared") >= SHARED)
    pairs = crossing(classed.join(shared, "node", "left_semi"), rows, ngram, threshold)
    more = verified(pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a"), nodes, rows, ngram, threshold)
    links = C.cut(links.unionByName(more))
    C.drop(classed, pairs)
    return signed.select("doc", "tk", "node"), C.cut(_with_classes(nodes.drop("keys"), links)), links


def _keys(depth: int, per_tree: list[int]) -> Column:
    """The keys at one depth: one of each tree."""
    place = per_tree.index(depth)
    return F.filter("keys", lambda _, i: F.pmod(i, F.lit(len(per_tree))) == place)


def _similar(one: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which texts of one block (rows) are similar to which of another (columns), by their distinct shingles; without
    another, to which of the same block but themselves."""
    texts = one + (other or [])
    sizes = np.array([len(x) for x in texts])
    values, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.r_[False, values[1:] != values[:-1]])
    n = len(one)
    held = np.bincount(column) > 1 if other is None else (np.bincount(column, owner < n) > 0) & (np.bincount(column, owner >= n) > 0)
    column, owner = (np.cumsum(held) - 1)[column[held[column]]], owner[held[column]]
    both = np.zeros((n, len(texts) - n if other is not None else n), np.int64)
    for low in range(0, int(held.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(texts), min(COLUMNS, int(held.sum()) - low)), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        both += (has[:n] @ (has if other is None else has[n:]).T).astype(np.int64)
    similar = both + 1e-9 >= threshold * (sizes[:n, None] + (sizes if other is None else sizes[n:])[None, :] - both)
    if other is None:
        np.fill_diagonal(similar, False)
    return similar


def _degrees(ngram: int, threshold: float):
    def counts(p: int, q: int, nodes: tuple[list, list], sets: tuple[list, list]) -> tuple[list, list]:
        if not sets[0] or p != q and not sets[1]:
            return [], []
        similar = _similar(sets[0], None if p == q else sets[1], threshold)
        return nodes[0] + nodes[1], [*similar.sum(1).tolist(), *(similar.sum(0).tolist() if p != q else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, ([], []), ([], [])
        frame = lambda out, n: pa.record_batch([pa.array(out, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])
        for batch in batches:
            comps, ps, qs, sides, ids = (batch[c].to_pylist() for c in ("comp", "p", "q", "side", "node"))
            out, n = [], []
            for at, to, w in K.batches_of(batch["text"]):
                g, begin = shingles(w, ngram)
                for i in range(at, to):
                    if key != (comps[i], ps[i], qs[i]):
                        if key:
                            for kept, new in zip((out, n), counts(*key[1:], nodes, sets), strict=True):
                                kept += new
                        key, nodes, sets = (comps[i], ps[i], qs[i]), ([], []), ([], [])
                    nodes[sides[i]].append(ids[i])
                    sets[sides[i]].append(np.unique(g[begin[i - at] : begin[i - at + 1]]))
            yield frame(out, n)
        if key:
            yield frame(*counts(*key[1:], nodes, sets))
        K.trim()

    return run


def degrees(nodes: DataFrame, rows: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(node, n_links) of nodes in classes of two or more: all pairs of a class, each two blocks of it in one group."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / PAIRED, F.sum("size") / SHINGLES)).cast("int")
    several = nodes.groupBy("comp").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    texts = nodes.join(several, "comp").select("comp", "node", "blocks", own, "doc", "tk").join(rows, ["doc", "tk"])
    texts = texts.dropDuplicates(["node"]).select("comp", "node", "own", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    dealt = texts.select("comp", F.least("own", "met").alias("p"), F.greatest("own", "met").alias("q"), (F.col("own") > F.col("met")).cast("int").alias("side"), "node", "text")
    spread = dealt.repartition(F.col("comp"), F.col("p"), F.col("q")).sortWithinPartitions("comp", "p", "q", "side")
    counted = spread.mapInArrow(_degrees(ngram, threshold), "node long, n long")
    return C.cut(counted.groupBy("node").agg(F.sum("n").alias("n_links")), free=True)


def similarity_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ngram: int = NGRAM, threshold: float = THRESHOLD, counted: bool = True) -> DataFrame:
    """(doc, tk, class_id, first, n_links, n_copies) for each document with a word; first: (doc, tk) of the
    class's first document. doc is doc_id, or the largest long where that is null. Without ``counted`` links are
    not counted, and n_links is left out."""
    signed, nodes, _ = links_of(docs, text, doc_id, ngram, threshold)
    classes = nodes.groupBy("comp").agg(F.min(F.struct("doc", "tk")).alias("first"))
    full = nodes.join(classes, "comp").select("node", "first", "n_copies")
    n_links = []
    if counted:
        full = full.join(degrees(nodes, _documents(docs, text, doc_id), ngram, threshold), "node", "left")
        n_links = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    return signed.join(full, "node").select("doc", "tk", F.col("first.doc").alias("class_id"), "first", *n_links, "n_copies")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = similarity_classes(docs).drop("first").distinct()
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("tk"))
    id_of = F.when(F.col("class_id") != _LAST, F.col("class_id"))
    return own.join(found, ["doc", "tk"], "left").select(
        "doc_id", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(id_of).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **rule) -> DataFrame:
    """docs without the documents that are in the class of an earlier one; of equal rows one stays. Texts without a
    word have no class: of those that are equal the first document stays."""
    found = similarity_classes(docs, text, doc_id, counted=False, **rule)
    keep = found.where((F.col("doc") == F.col("first.doc")) & (F.col("tk") == F.col("first.tk"))).select(F.col("doc").alias("_doc"), F.col("tk").alias("_tk"), F.lit(True).alias("_first")).distinct()
    drop = found.select(F.col("doc").alias("_doc"), F.col("tk").alias("_tk")).distinct().join(keep, ["_doc", "_tk"], "left")
    rows = docs.select(C.packed(docs), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("_d"), F.xxhash64(text).alias("_t"))
    joined = rows.join(drop, (rows["_d"] == drop["_doc"]) & (rows["_t"] == drop["_tk"]), "left")
    wordless = joined.where("_doc IS NULL").groupBy("_t").agg(F.min(F.struct("_d", "_row")).alias("_one")).select("_one._row")
    firsts = joined.where("_first").groupBy("_d", "_t").agg(F.min("_row").alias("_row")).select("_row")
    return firsts.unionByName(wordless).select(*C.unpacked("_row", docs.columns))

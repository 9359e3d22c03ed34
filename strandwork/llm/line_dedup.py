"""Operator 7: line dedup that returns keep bitmaps.

Lines become 128-bit hashes of their keys. These are range-partitioned by (hash, document), sorted within
partitions by (hash, document, position), and streamed: a window over that order numbers the lines of each
(hash, document) run, and its first is that document's first occurrence. A range on hash *and* document lets one line
that a third of all documents hold spread over many partitions; what then meets at a hash is one partial row from each
partition.

Which lines go is returned as a run-length bitmap: the runs ``(start, len)`` of kept lines of each document. Hashes that
go are brought back to the lines by a broadcast of the most frequent ones, whose number is bounded (BROADCAST_KEYS),
and by a shuffle of the others, of which none has more than a BROADCAST_KEYS-th of all lines.

Cases: a null or empty text is one empty line; a very long text is so many rows of lines, and one bitmap; keys shorter
than ``min_chars`` code points are never dropped; rows that repeat a doc_id count as documents of their own unless their
texts are equal as well, and then they count once and get equal results; of equal lines in one document the first
counts; a null doc_id is a value like others; an empty table gives an empty result; all columns of a document ride along
in one struct, whatever their names. Two different keys are held apart by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

RUNS = "array<struct<start:int,len:int>>"
#: So many hashes of lines (24 bytes each) are broadcast at most; there can't be more that hold this part of all lines.
BROADCAST_KEYS = 100_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(C.BLANKS)), C.UPPER, C.UPPER.lower())


def lines_of(text: Column) -> Column:
    return F.split(C.text_of(text), "\n")


def _hashed_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    key = line_key(F.col("_line"))
    return (
        docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_tk"), F.posexplode(lines_of(F.col(text))).alias("_pos", "_line"))
        .select("_doc", "_tk", "_pos", key.alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(*[h.alias(f"_h{i}") for i, h in enumerate(C.two_hashes(F.col("_key")))], "_doc", "_tk", "_pos")
    )


def line_occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 1) -> tuple[DataFrame, DataFrame]:
    """The hashed lines, and for each hash how many documents hold it and where it comes first."""
    lines = C.cut(_hashed_lines(docs, text, doc_id, min_chars))
    order = ["_h0", "_h1", "_doc", "_tk"]
    streamed = lines.repartitionByRange(*order).sortWithinPartitions(*order, "_pos")
    firsts = streamed.withColumn("_nth", F.row_number().over(Window.partitionBy(*order).orderBy("_pos"))).where("_nth = 1")
    return lines, firsts.groupBy("_h0", "_h1").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("_doc", "_tk", "_pos")).alias("first"))


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(_doc, _tk, dropped): for each document with any, the positions of lines whose key is in at least
    ``min_docs`` documents. keep_first: but not the first of all, by document, then position."""
    lines, keys = line_occurrences(docs, text, doc_id, min_chars)
    keys = C.cut(keys.where(F.col("n_docs") >= min_docs).select("_h0", "_h1", "n_docs", *(["first"] if keep_first else [])))
    if keys.count() <= BROADCAST_KEYS:
        hit = lines.join(F.broadcast(keys), ["_h0", "_h1"])
    else:  # a hash counts a document once, so fewer than BROADCAST_KEYS have more documents than this
        often = F.col("n_docs") * F.lit(BROADCAST_KEYS) > F.lit(lines.count())
        hot = F.broadcast(keys.where(often))
        hit = lines.join(hot, ["_h0", "_h1"]).unionByName(lines.join(hot, ["_h0", "_h1"], "left_anti").join(keys.where(~often), ["_h0", "_h1"]))
    if keep_first:
        hit = hit.where(~F.struct("_doc", "_tk", "_pos").eqNullSafe(F.col("first")))
    return hit.groupBy("_doc", "_tk").agg(F.sort_array(F.collect_set("_pos")).alias("dropped"))


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """The bitmap of kept lines as runs: what lies between two dropped positions that follow each other."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(n_lines))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **rule) -> DataFrame:
    """One row per document: _row (its columns), n_lines, n_dropped and keep, the runs of kept lines."""
    gone = dropped_lines(docs, text, doc_id, **rule).withColumnsRenamed({"_doc": "_gone_doc", "_tk": "_gone_tk"})
    n = F.size(lines_of(F.col(text)))
    rows = docs.select(C.packed(docs), F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_tk"), n.alias("n_lines"))
    joined = rows.join(gone, (rows["_tk"] == gone["_gone_tk"]) & rows["_doc"].eqNullSafe(gone["_gone_doc"]), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select("_row", "n_lines", F.size(dropped).alias("n_dropped"), keep_runs(F.col("n_lines"), dropped).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines, joined by \\n."""
    lines = lines_of(text)
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["len"]))), "\n")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup(docs, min_docs=10, min_chars=1)
    row_text = C.text_of(F.col("_row.text"))
    text = F.when(F.col("n_dropped") == 0, row_text).otherwise(kept_text(row_text, F.col("keep")))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT y.*, c.k IS NOT NULL AS gone FROM keyed y LEFT JOIN common c ON y.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""Operator 3: document fingerprints from closed syncmers.

A text is a sequence of symbols (words; or code points, for scripts without blanks). A k-mer of SYMBOLS of them is
chosen if the least of the hashes of its inner s-mers lies at its first or its last place. Whether it is chosen
depends on its own symbols only: an edit elsewhere, or an insertion before it, doesn't change it, and of SYMBOLS -
INNER places in a row at least one is chosen. Chosen k-mers are anchors, with their places.

Two texts are compared by all of their anchors, however many: ``likeness`` is the Jaccard of their anchors' hashes (64
bits). ``aligned`` matches them by position: a link is an anchor, the next one and the distance between their places,
which a shared passage keeps wherever it stands, and links are compared as anchors are; blocks of words in another order,
or gaps, lower it. For storage a fingerprint is written as the upper half of its SKETCH least anchor hashes, 8 digits
each; comparisons don't use that string.

The edited text needs each document's next one. Documents are dealt into ranges of doc_id, one shuffle, and sorted
there; the first of a range is also dealt to the range before it, so that no row needs a second place in the order.

Cases: a null text is empty; a text without symbols has the empty fingerprint, two of these are alike (1.0), one
and another text are not (0.0); texts of fewer than SYMBOLS symbols have one anchor, the whole; a very long text has as
many anchors as it needs; of equal anchors or links in a text one counts; a null doc_id comes last, rows with equal ids
follow each other by text (one range holds them); equal rows have equal fingerprints; a table of one row is its own
next; an empty table gives an empty result; fingerprints() keeps all columns but those of its own names (those that
begin with an underscore are dropped), the query reads none but doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = 5
INNER = 2
SKETCH = 96
#: Ranges of doc_id for each shuffle partition.
RANGES = 4


def symbols_of(text: Column, unit: str = "word") -> Column:
    """The symbols of a text that isn't null."""
    return C.words_of(text) if unit == "word" else F.array_remove(F.split(text, ""), "")


def with_anchors(df: DataFrame, text: str, out: str, unit: str = "word") -> DataFrame:
    """df with the column ``out``: array<struct<pos:int,hash:long>>, the anchors of the (not null) text."""
    w, h = f"_{out}_words", f"_{out}_inner"
    df = df.withColumn(w, symbols_of(F.col(text), unit))
    n = F.size(w)
    inner = F.transform(F.sequence(F.lit(0), n - INNER), lambda i: F.xxhash64(*[F.col(w)[i + j] for j in range(INNER)]))
    df = df.withColumn(h, F.when(n >= SYMBOLS, inner))
    last = SYMBOLS - INNER
    at_edge = lambda i: F.least(F.col(h)[i], F.col(h)[i + last]) <= F.least(*[F.col(h)[i + j] for j in range(1, last)])
    whole = lambda i: F.xxhash64(*[F.col(h)[i + j] for j in range(0, last, INNER)], F.col(h)[i + last])
    anchor = lambda i: F.struct(i.alias("pos"), whole(i).alias("hash"))
    chosen = F.transform(F.filter(F.sequence(F.lit(0), n - SYMBOLS), at_edge), anchor)
    short = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.array_join(w, " ")).alias("hash")))
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return df.withColumn(out, F.when(n >= SYMBOLS, chosen).when(n > 0, short).otherwise(none)).drop(w, h)


def hashes_of(anchors: Column) -> Column:
    """The distinct hashes of the anchors."""
    return F.array_distinct(anchors.getField("hash"))


def links_of(anchors: Column) -> Column:
    """Distinct hashes of each anchor with the next one and the distance between them; the last has none after it."""
    gap = lambda a, i: F.get(anchors, i + 1)["pos"] - a["pos"]
    return F.array_distinct(F.transform(anchors, lambda a, i: F.xxhash64(a["hash"], F.get(anchors, i + 1)["hash"], gap(a, i))))


def as_string(hashes: Column) -> Column:
    """The SKETCH least of the hashes' upper halves."""
    least = F.slice(F.sort_array(F.transform(hashes, lambda x: F.call_function("shiftrightunsigned", x, F.lit(32)))), 1, SKETCH)
    return F.array_join(F.transform(least, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard of two arrays of distinct hashes; 1.0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every).cast("double")


def _long_array(values: list[int]) -> Column:
    """One literal, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """(doc_id, text, next_text, _range) in descending order of doc_id; nulls are empty texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), C.text_of(text).alias("text"))
    n = ranges or RANGES * C.partitions(spark)
    found = rows.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 1 / (4 * n))
    bounds = sorted({int(x) for x in found}, reverse=True)
    if bounds:
        step = 64
        above = lambda values: F.size(F.filter(values, lambda x: x > F.col("doc_id")))
        coarse = above(_long_array(bounds[step - 1 :: step])) if len(bounds) >= step else F.lit(0)
        rows = rows.withColumn("_coarse", coarse * step)
        rows = rows.withColumn("_range", F.col("_coarse") + above(F.slice(_long_array(bounds), F.col("_coarse") + 1, F.lit(step)))).drop("_coarse")
        rows = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.col("_range")))
    else:
        rows = rows.withColumn("_range", F.lit(0))
    firsts = sorted((r["_range"], r["top"]) for r in rows.groupBy("_range").agg(F.max("doc_id").alias("top")).collect())  # a row for each range
    before = [(r, top, firsts[i - 1][0]) for i, (r, top) in enumerate(firsts)]  # the first range's comes after the last's
    table = F.broadcast(spark.createDataFrame(before, "_r int, _top long, _before int"))
    rows = rows.join(table, rows["_range"] == table["_r"])
    places = F.when(F.col("doc_id").eqNullSafe(F.col("_top")), F.array(F.struct("_range", F.lit(0).alias("_again")), F.struct(F.col("_before").alias("_range"), F.lit(1).alias("_again"))))
    places = F.coalesce(places, F.array(F.struct("_range", F.lit(0).alias("_again"))))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("_p")).select("doc_id", "text", "_p.*")
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def _order() -> Window:
    return Window.partitionBy("_range").orderBy("_again", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame, text: str = "text", unit: str = "word") -> DataFrame:
    """docs with anchors (array of pos and hash) and fingerprint."""
    a = with_anchors(docs.withColumn("_text", C.text_of(text)), "_text", "_anchors", unit)
    a = a.withColumns({"anchors": F.col("_anchors"), "fingerprint": as_string(hashes_of(F.col("_anchors")))})
    return a.drop("_text", "_anchors")


def query(spark, sf_dir: str) -> DataFrame:
    docs = with_next(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    # A copy from an earlier range has no next row; it is there for its text and anchors only.
    replaced = F.concat(F.left("text", n - half), F.left(C.text_of("next_text"), half))
    docs = docs.select("doc_id", "_range", "_again", "text", n.cast("long").alias("n_chars"), F.when(F.col("_again") == 0, replaced).otherwise("").alias("edited"))
    sets = lambda c: F.struct(hashes_of(F.col(c)).alias("hashes"), links_of(F.col(c)).alias("links"))
    docs = with_anchors(docs, "text", "_a").withColumn("_own", sets("_a")).drop("_a")
    docs = docs.withColumn("_next", F.lead("_own").over(_order())).where("_again = 0")
    docs = with_anchors(docs, "edited", "_b").withColumn("_edited", sets("_b")).drop("_b")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("_own.hashes")).alias("fingerprint"),
        as_string(F.col("_edited.hashes")).alias("edited_fingerprint"),
        likeness(F.col("_own.hashes"), F.col("_edited.hashes")).alias("near_edited"),
        likeness(F.col("_own.hashes"), F.col("_next.hashes")).alias("near_next"),
        likeness(F.col("_own.links"), F.col("_edited.links")).alias("aligned_edited"),
        likeness(F.col("_own.links"), F.col("_next.links")).alias("aligned_next"),
    )

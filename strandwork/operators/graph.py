"""The macro-node graph: nodes are (k-1)-mers, each with prefix and suffix extensions.

node_ext: node, side ('P' or 'S'), ext, terminal, cnt, visit, and ext_id, the row's number within (node, side).
ext_id 0 is the null extension: it is '' and terminal, and balances the visits of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encoding as E


def extensions(solid_kmers: DataFrame, k: int, coverage: int) -> DataFrame:
    """(node, side, ext, terminal, cnt, visit): each k-mer is a suffix of its first k-1 bases and a prefix of its last.
    Both come from one scan of the k-mers: no join."""
    sides = F.explode(
        F.array(
            F.struct(E.prefix("kmer", k).alias("node"), F.lit("S").alias("side"), F.substring("kmer", k, 1).alias("ext")),
            F.struct(E.suffix("kmer", k).alias("node"), F.lit("P").alias("side"), F.substring("kmer", 1, 1).alias("ext")),
        )
    )
    visit = F.ceil(F.col("cnt") / F.lit(coverage)).cast("long")
    return solid_kmers.select("cnt", sides.alias("e")).select("e.*", F.lit(False).alias("terminal"), "cnt", visit.alias("visit"))


def balance(ext: DataFrame) -> DataFrame:
    """(node, p_visit, s_visit, null_p, null_s): visits of each side, and what the null extensions make up."""
    side = lambda s: F.sum(F.when((F.col("side") == s) & (F.col("ext") != ""), F.col("visit")).otherwise(0))
    sums = ext.groupBy("node").agg(side("P").alias("p_visit"), side("S").alias("s_visit"))
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0).cast("long"))
    return sums.select("node", "p_visit", "s_visit", more("s_visit", "p_visit").alias("null_p"), more("p_visit", "s_visit").alias("null_s"))


def build(solid_kmers: DataFrame, k: int, coverage: int) -> DataFrame:
    """node_ext with null extensions, numbered by base within each side."""
    ext = extensions(solid_kmers, k, coverage)
    nulls = balance(ext).select("node", F.explode(F.array(F.struct(F.lit("P").alias("side"), F.col("null_p").alias("visit")), F.struct(F.lit("S").alias("side"), F.col("null_s").alias("visit")))).alias("n"))
    nulls = nulls.select("node", "n.side", F.lit("").alias("ext"), F.lit(True).alias("terminal"), F.lit(1).cast("long").alias("cnt"), "n.visit")
    number = F.row_number().over(Window.partitionBy("node", "side").orderBy("ext")) - 1
    return ext.unionByName(nulls).withColumn("ext_id", number)


def nodes(ext: DataFrame) -> DataFrame:
    return ext.select("node").distinct()


def base_pivot(ext: DataFrame) -> DataFrame:
    """(node, p0..p3, s0..s3): counts of the single-base extensions by base."""
    cell = lambda s, b: F.sum(F.when((F.col("side") == s) & (F.col("ext") == b), F.col("cnt")).otherwise(0)).alias(f"{s.lower()}{b}")
    return ext.groupBy("node").agg(*[cell(s, b) for s in "PS" for b in E.DIGITS])


def meets_threshold(pivot: DataFrame, least: int) -> DataFrame:
    """Nodes with a counter that reaches it."""
    return pivot.where(F.greatest(*[F.col(f"{s}{b}") for s in "ps" for b in E.DIGITS]) >= least)


def neighbor(side: Column, node: Column, ext: Column, k: int) -> tuple[Column, Column]:
    """(key, back): the node on the other side of an extension, and this node's extension as seen from there."""
    whole = F.when(side == "P", F.concat(ext, node)).otherwise(F.concat(node, ext))
    n = F.length(whole)
    key = F.when(side == "P", F.substring(whole, F.lit(1), F.lit(k - 1))).otherwise(F.substring(whole, n - (k - 2), F.lit(k - 1)))
    back = F.when(side == "P", F.substring(whole, F.lit(k), n)).otherwise(F.substring(whole, F.lit(1), n - (k - 1)))
    return key, back


def neighbors(ext: DataFrame, k: int) -> DataFrame:
    """(node, side, ext, neighbor, back) of extensions that aren't terminal."""
    key, back = neighbor(F.col("side"), F.col("node"), F.col("ext"), k)
    return ext.where(~F.col("terminal")).select("node", "side", "ext", key.alias("neighbor"), back.alias("back"))


def begin_nodes(ext: DataFrame) -> DataFrame:
    """Where walks begin: terminal prefixes with visits."""
    return ext.where((F.col("side") == "P") & F.col("terminal") & (F.col("visit") > 0)).select("node", "ext", "ext_id", "visit")


def dump(ext: DataFrame) -> DataFrame:
    """(node, prefixes, suffixes): each node's extensions as text, 'ext:cnt:visit' by number, terminal ones with a '$'."""
    one = F.concat("ext", F.when(F.col("terminal"), "$").otherwise(""), F.lit(":"), F.col("cnt").cast("string"), F.lit(":"), F.col("visit").cast("string"))
    rows = ext.select("node", "side", F.struct("ext_id", one.alias("text")).alias("e"))
    of = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("e")))), lambda e: e["text"]), ",")
    return rows.groupBy("node").agg(of("P").alias("prefixes"), of("S").alias("suffixes"))

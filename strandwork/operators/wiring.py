"""Wiring: which prefix visits of a node go on to which suffix.

Both sides, ordered by visits, lie as intervals on one line of the same length; a wire is an overlap of two. So: a
running sum on each side, then one pass over the points of a node where an interval of either side begins: from each to
the next point the same prefix and the same suffix go on, and these are the last ones that began. That is linear in a
node's extensions, however many it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(ext: DataFrame) -> DataFrame:
    """node_ext with lo and hi. Order: visits, then counts, most first; then not terminal, short, by base, by id."""
    order = [F.col("visit").desc(), F.col("cnt").desc(), F.col("terminal"), F.length("ext"), F.col("ext"), F.col("ext_id")]
    upto = F.sum("visit").over(Window.partitionBy("node", "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ext.where("visit > 0").withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("visit"))


def wires(ext: DataFrame) -> DataFrame:
    """(node, p_id, s_id, off_p, off_s, cnt)."""
    at = lambda side, name: F.max(F.when(F.col("side") == side, F.struct("ext_id", "lo", "hi"))).alias(name)
    points = intervals(ext).groupBy("node", "lo").agg(at("P", "_p"), at("S", "_s"))
    line = Window.partitionBy("node").orderBy("lo")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    both = points.select("node", "lo", F.last("_p", True).over(upto).alias("p"), F.last("_s", True).over(upto).alias("s"), F.lead("lo").over(line).alias("_next"))
    end = F.least("p.hi", "s.hi", "_next")  # the last point has no next
    return both.where(end > F.col("lo")).select(
        "node", F.col("p.ext_id").alias("p_id"), F.col("s.ext_id").alias("s_id"), (F.col("lo") - F.col("p.lo")).alias("off_p"), (F.col("lo") - F.col("s.lo")).alias("off_s"), (end - F.col("lo")).alias("cnt")
    )


def invariants(ext: DataFrame, wired: DataFrame) -> DataFrame:
    """One row: nodes, nodes whose sides differ, visits, and what the wires carry (the same)."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("visit")).otherwise(0))
    sums = ext.groupBy("node").agg(side("P").alias("p"), side("S").alias("s"))
    a = sums.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.when(F.col("p") != F.col("s"), 1).otherwise(0)).cast("long").alias("n_unbalanced"), F.sum("p").alias("n_visits"))
    return a.crossJoin(wired.agg(F.count(F.lit(1)).alias("n_wires"), F.sum("cnt").alias("n_wired")))

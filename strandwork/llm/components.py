"""Connected components of a link table, as frames: neighbours' least label, then the label's own label, until
nothing changes. Each round halves what is left of long chains; a star takes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of links (a, b); comp is the least node of the component."""
    both = C.cut(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels, read = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), ()
    while True:
        kept = C.cut(labels)
        C.drop(*read)
        near = both.join(kept.select(F.col("node").alias("other"), F.col("comp").alias("_near")), "other").groupBy("node").agg(F.min("_near").alias("_near"))
        next_ = kept.join(near, "node").select("node", F.least("comp", "_near").alias("_next"), "comp")
        jump = kept.select(F.col("node").alias("_next"), F.col("comp").alias("_jump"))
        next_ = C.cut(next_.join(jump, "_next", "left").select("node", F.least("_next", F.coalesce("_jump", "_next")).alias("next"), "comp"))
        if not next_.where("next < comp").limit(1).count():
            C.drop(both, next_)
            return kept
        labels, read = next_.select("node", F.col("next").alias("comp")), (kept, next_)

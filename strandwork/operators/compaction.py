"""Compaction: rounds that delete an independent set of nodes and hand what they held to their neighbors.

A round is a chain of joins on the node key. Wires are a function of a node's extensions, so only those of the nodes
that go are made in a round. State is cut (written and read back) once a round, and that of the round before is deleted;
partial contigs are added to one table. So neither plans nor disk grow with the number of rounds.

A round costs what its joins do, however few nodes are left, and rounds get small long before they end. So once the graph
is small, as measured, one task makes the rounds on it that are left.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import small
from .graph import neighbor
from .wiring import wires

#: A graph of at most so many rows and so much text in them is compacted by one task; it stops at four times that.
FEW, TEXT = 400_000, 32 << 20


def independent_set(ext: DataFrame, k: int) -> DataFrame:
    """(node): nodes without a neighbor of a greater key. No two are neighbors; the greatest key is always in it."""
    key, _ = neighbor(F.col("side"), F.col("node"), F.col("ext"), k)
    top = F.max(F.when(~F.col("terminal"), key)).alias("top")
    return ext.groupBy("node").agg(top).where("top IS NULL OR top <= node").select("node")


def paths_through(ext: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """For each wire of the chosen nodes its prefix and suffix, and the nodes they lead to (null if terminal)."""
    mine = ext.join(chosen, "node", "left_semi")
    key, back = neighbor(F.col("side"), F.col("node"), F.col("ext"), k)
    open_ = ~F.col("terminal")
    mine = mine.withColumn("to", F.when(open_, key)).withColumn("back", F.when(open_, back))
    pick = lambda side, p: mine.where(F.col("side") == side).select("node", *[F.col(c).alias(f"{p}_{c}") for c in ("ext", "terminal", "cnt", "to", "back")], F.col("ext_id").alias(f"{p}_id"))
    return wires(mine).join(pick("P", "p"), ["node", "p_id"]).join(pick("S", "s"), ["node", "s_id"])


def transfers(paths: DataFrame) -> DataFrame:
    """Messages (search_mn, search_ext, mn_ext, cnt, visit, terminal, direction): 'P' to the predecessor, whose suffix
    grows; 'S' to the successor, whose prefix does. A node sends nothing to itself; what would have gone on into it
    ends there."""
    to_self = lambda p: F.coalesce(F.col(f"{p}_to") == F.col("node"), F.lit(False))

    def message(here: str, there: str, direction: str):
        sent = ~F.col(f"{here}_terminal") & ~to_self(here)
        ends = F.col(f"{there}_terminal") | to_self(there)
        return F.when(
            sent,
            F.struct(
                F.col(f"{here}_to").alias("search_mn"), F.col(f"{here}_back").alias("search_ext"), F.col(f"{there}_ext").alias("mn_ext"),
                F.least("p_cnt", "s_cnt").alias("cnt"), F.col("cnt").alias("visit"), ends.alias("terminal"), F.lit(direction).alias("direction"),
            ),
        )

    return paths.select(F.explode(F.array_compact(F.array(message("p", "s", "P"), message("s", "p", "S")))).alias("m")).select("m.*")


def partial_contigs(paths: DataFrame) -> DataFrame:
    """(contig): what passes a node from a terminal prefix to a terminal suffix."""
    return paths.where("p_terminal AND s_terminal").select(F.concat("p_ext", "node", "s_ext").alias("contig"))


def apply_transfers(ext: DataFrame, chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """node_ext without the chosen nodes and with what they sent: an extension that led to one goes, once for all
    messages that name it, and each message becomes an extension."""
    left = ext.join(chosen, "node", "left_anti")
    side = F.when(F.col("direction") == "P", "S").otherwise("P")
    named = messages.select(F.col("search_mn").alias("node"), side.alias("side"), F.col("search_ext").alias("ext"), F.lit(False).alias("terminal")).distinct()
    first = F.row_number().over(Window.partitionBy("node", "side", "ext", "terminal").orderBy("ext_id"))
    kept = left.withColumn("_n", first).join(named.withColumn("_named", F.lit(True)), ["node", "side", "ext", "terminal"], "left").where("_named IS NULL OR _n > 1")
    grown = F.when(F.col("direction") == "P", F.concat("search_ext", "mn_ext")).otherwise(F.concat("mn_ext", "search_ext"))
    new = messages.select(F.col("search_mn").alias("node"), side.alias("side"), grown.alias("ext"), "terminal", "cnt", "visit")
    every = kept.select("node", "side", "ext", "terminal", "cnt", "visit").unionByName(new)
    return every.withColumn("ext_id", F.row_number().over(Window.partitionBy("node", "side").orderBy("terminal", "ext", F.col("visit").desc(), F.col("cnt").desc())) - 1)


def _measure(ext: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text of node_ext."""
    row = ext.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("ext")), F.lit(0)).alias("text")).first()
    return row["n"], row["text"]


def compact(ext: DataFrame, k: int, node_threshold: int, max_rounds: int | None = None, seconds: list[float] | None = None) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """(node_ext, partial contigs, (nodes, chosen, messages) of each round): rounds until there are at most
    node_threshold nodes. The driver holds three numbers a round; seconds, if given, gets what each took."""
    spark, rounds, took = ext.sparkSession, [], []
    ext, found = tables.cut(ext), tables.new_path(ext.sparkSession)
    n = ext.select("node").distinct().count()
    while n > node_threshold and (max_rounds is None or len(rounds) < max_rounds):
        size, text = _measure(ext)
        if size <= FEW and text <= TEXT:
            most = None if max_rounds is None else max_rounds - len(rounds)
            made = tables.cut(ext.select("node", "side", "ext", "terminal", "cnt", "visit", "ext_id").coalesce(1).mapInArrow(small.rounds(k, n, node_threshold, most, 4 * FEW, 4 * TEXT), small.ROUNDS))
            tables.write(made.where("kind = 1").select(F.col("ext").alias("contig")), found)
            for r in made.where("kind = 2").select("cnt", "visit", "messages", "seconds").orderBy("ext_id").collect():
                rounds.append((r["cnt"], r["visit"], r["messages"]))
                took.append(r["seconds"])
            before, ext = ext, tables.cut(made.where("kind = 0").select(*ext.columns))
            n = rounds[-1][0] - rounds[-1][1]
            tables.drop(before, made)
            continue
        began = time.monotonic()
        chosen = tables.cut(independent_set(ext, k))
        paths = tables.cut(paths_through(ext, chosen, k))
        messages = tables.cut(transfers(paths))
        tables.write(partial_contigs(paths), found)
        before, ext = ext, tables.cut(apply_transfers(ext, chosen, messages))
        rounds.append((n, chosen.count(), messages.count()))
        n -= rounds[-1][1]
        tables.drop(before, chosen, paths, messages)
        took.append(time.monotonic() - began)
    if seconds is not None:
        seconds.extend(took)
    return ext, spark.read.schema("contig string").parquet(found) if rounds else ext.limit(0).select(F.col("node").alias("contig")), rounds

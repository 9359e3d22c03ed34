"""Walks: from terminal prefixes along wires to terminal suffixes. All walks take a step at once; a step is one join
with a table of edges, in which the lookup of the next node's prefix is already made.

A walk carries numbers, not its text. The visits it began with are an interval; each step keeps a part of it, and where
a walk branches the parts don't overlap. So a step leaves (seed, step, part, text of the suffix), and the contig of a
walk that ends is made of the steps whose parts hold its own, joined once at the end.

A step costs what a join does, however few walks take it. So where there are few edges, one task takes all walks one
after the other; where there are many, edges that can only be taken one after the other are made one first, so that a
step goes to the next place where a walk may branch or meet another, and not by one base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions import small
from .graph import begin_nodes, neighbor
from .wiring import wires

#: Longer contigs are an error.
MOST = 500_000
#: Edges of up to so many bytes are walked by one task, which holds two and a half times that.
FEW = 128 << 20
#: Of more, those of up to so many bytes are sent to all executors, larger tables are dealt by their node.
BROADCAST = 32 << 20


def edges(ext: DataFrame, k: int) -> DataFrame:
    """(node, p_id, start, size, off_s, s_ext, done, next_node, next_p): each wire with its suffix and where it leads:
    the first prefix of the next node whose text is this node's way back."""
    key, back = neighbor(F.col("side"), F.col("node"), F.col("ext"), k)
    suffixes = ext.where("side = 'S'").select("node", F.col("ext_id").alias("s_id"), F.col("ext").alias("s_ext"), F.col("terminal").alias("done"), key.alias("_to"), back.alias("_back"))
    prefixes = ext.where("side = 'P'").groupBy(F.col("node").alias("_to"), F.col("ext").alias("_back")).agg(F.min("ext_id").alias("next_p"))
    led = suffixes.join(prefixes, ["_to", "_back"], "left")
    out = wires(ext).join(led, ["node", "s_id"])
    ahead = ~F.col("done")
    return out.select(
        "node", "p_id", F.col("off_p").alias("start"), F.col("cnt").alias("size"), "off_s", "s_ext", "done", F.when(ahead, F.col("_to")).alias("next_node"), F.when(ahead, F.col("next_p")).alias("next_p")
    )


def _behind(edge_table: DataFrame, begins: DataFrame) -> DataFrame:
    """(id, at, dist, shift): edges that are only entered from one edge, at, and by all of its visits. shift is how much
    further into its own interval a visit then is. Where a walk may begin, none is."""
    there = edge_table.select(F.col("node").alias("next_node"), F.col("p_id").alias("next_p"), F.col("start").alias("_start"), (F.col("start") + F.col("size")).alias("_end"), F.col("id").alias("_id"))
    end = F.col("off_s") + F.col("size")
    met = edge_table.where("NOT done").join(there, ["next_node", "next_p"]).where((F.col("_start") < end) & (F.col("off_s") < F.col("_end")))
    whole = (F.col("_start") <= F.col("off_s")) & (end <= F.col("_end"))
    one = met.groupBy("_id", "next_node", "next_p").agg(F.count(F.lit(1)).alias("n"), F.every(whole).alias("whole"), F.max("id").alias("at"), F.max(F.col("off_s") - F.col("_start")).alias("shift")).where("n = 1 AND whole")
    free = one.join(begins.select(F.col("node").alias("next_node"), F.col("ext_id").alias("next_p")), ["next_node", "next_p"], "left_anti")
    return free.select(F.col("_id").alias("id"), "at", F.lit(1).cast("long").alias("dist"), "shift")


def chained(edge_table: DataFrame, begins: DataFrame) -> DataFrame:
    """edge_table with each longest row of edges that only follow each other as one edge. Each edge looks for the first of
    its row, four times as far back in each round; edges of a circle have no first one and stay as they are."""
    numbered = tables.cut(edge_table.withColumn("id", F.monotonically_increasing_id()))
    now = tables.cut(_behind(numbered, begins))
    n, reach = now.count(), 1
    while n and reach <= 4 * n:
        to = now.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("dist").alias("_dist"), F.col("shift").alias("_shift"))
        far = now.withColumn("open", F.lit(True))
        for _ in range(3):
            more = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0).cast("long"))).alias(c)
            far = far.join(to, F.col("at") == F.col("_id"), "left").select("id", F.coalesce("_at", "at").alias("at"), more("dist"), more("shift"), F.col("_id").isNotNull().alias("open"))
        before, far = now, tables.cut(far)
        tables.drop(before)
        now, reach = far.drop("open"), 4 * reach
        left = far.where("open").limit(1).count()
        if not left:
            break
        if reach > 4 * n:
            now = far.where("NOT open").drop("open")
    first, last = F.struct("node", "p_id", "start", "size"), F.struct("off_s", "shift", "done", "next_node", "next_p")
    rows = numbered.join(now, "id", "left").withColumn("head", F.coalesce("at", "id")).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("dist", "shift")})
    made = rows.groupBy("head").agg(F.min_by(first, "dist").alias("a"), F.max_by(last, "dist").alias("b"), F.sort_array(F.collect_list(F.struct("dist", "s_ext"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["s_ext"]), "")
    out = tables.cut(made.select("a.*", (F.col("b.off_s") + F.col("b.shift")).alias("off_s"), text.alias("s_ext"), "b.done", "b.next_node", "b.next_p"))
    tables.drop(numbered, now)
    return out


def taken(off: Column, freq: Column, start: Column, size: Column, mode: str) -> Column:
    """Does the interval [off, off + freq) go on along a wire? In 'reference' mode not along one that begins past its
    middle; in 'full' mode along each that it overlaps."""
    if mode == "full":
        return (start + size > off) & (start < off + freq)
    return (start + size > off) & ((start <= off) | (2 * (start - off) <= freq))


def _bytes(table: DataFrame, k: int) -> int:
    """The measured size of edges."""
    row = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("s_ext")), F.lit(0)).alias("text")).first()
    return row["n"] * (2 * k + 100) + row["text"]


def _at_once(edge_table: DataFrame, begins: DataFrame, mode: str) -> DataFrame:
    """(contig): all walks in one task."""
    null = lambda t: F.lit(None).cast(t)
    seeds = begins.select("node", F.col("ext_id").alias("p_id"), null("long").alias("start"), F.col("visit").alias("size"), null("long").alias("off_s"), F.concat("ext", "node").alias("s_ext"), F.lit(False).alias("done"), null("string").alias("next_node"), null("int").alias("next_p"))
    both = edge_table.select(*seeds.columns).unionByName(seeds)
    return both.coalesce(1).mapInArrow(small.walks(mode, MOST), "contig string")


def walk(ext: DataFrame, k: int, mode: str = "reference", keep_every: int = 8) -> DataFrame:
    """(contig): a row for each walk that ends. Edges of up to ``few`` bytes, as they are or when chained, are walked at
    once; else what is under way is cut every ``keep_every`` steps."""
    spark = ext.sparkSession
    edge_table = tables.cut(edges(ext, k))
    if (size := _bytes(edge_table, k)) > FEW:
        before, edge_table = edge_table, chained(edge_table, begin_nodes(ext))
        tables.drop(before)
        size = _bytes(edge_table, k)
    if size <= FEW:
        made = tables.cut(_at_once(edge_table, begin_nodes(ext), mode))
        tables.drop(edge_table)
        return made
    ways = edge_table.withColumnsRenamed({"done": "e_done", "node": "e_node", "p_id": "e_p"})
    ways = F.broadcast(ways) if size <= BROADCAST else ways
    seed = F.struct("node", "ext_id").alias("seed")
    zero = F.lit(0).cast("long")
    begin = begin_nodes(ext).select(
        seed, F.lit(0).alias("step"), zero.alias("lo"), F.col("visit").alias("freq"), F.col("ext_id").alias("p_id"), "node", zero.alias("off"), F.concat("ext", "node").alias("text"), F.lit(False).alias("done")
    )
    steps = tables.new_path(spark)
    now = tables.cut(begin)
    tables.write(now.select("seed", "step", "lo", "freq", "text", "done"), steps)
    now = now.withColumn("parts", F.array(F.struct("step", "lo", "freq", "text", "done"))).drop("text")
    while now.limit(1).count():
        reached = now.withColumn("parts", F.slice("parts", 1, 0))
        for _ in range(keep_every):  # those that ended stay as they are
            on = (F.col("node") == F.col("e_node")) & (F.col("p_id") == F.col("e_p")) & ~F.col("done")
            hit = reached.join(ways, on & taken(F.col("off"), F.col("freq"), F.col("start"), F.col("size"), mode), "left").where("done OR e_node IS NOT NULL")
            at = F.greatest("off", "start")
            step, lo, freq = F.col("step") + 1, F.col("lo") + at - F.col("off"), F.least(F.col("off") + F.col("freq"), F.col("start") + F.col("size")) - at
            part = F.struct(step.alias("step"), lo.alias("lo"), freq.alias("freq"), F.col("s_ext").alias("text"), F.col("e_done").alias("done"))
            new = {"step": step, "lo": lo, "freq": freq, "p_id": F.col("next_p"), "node": F.col("next_node"), "off": F.col("off_s") + at - F.col("start"), "done": F.col("e_done"), "parts": F.concat("parts", F.array(part))}
            reached = hit.select("seed", *[F.when(F.col("done"), F.col(c)).otherwise(x).alias(c) for c, x in new.items()])
        reached = tables.cut(reached)
        # What several branches share, each of them has.
        tables.write(reached.select("seed", F.explode("parts").alias("p")).select("seed", "p.*").dropDuplicates(["seed", "step", "lo"]), steps)
        tables.drop(now)
        now = reached.where("NOT done")
    tables.drop(now, edge_table)
    return contigs(spark.read.schema("seed struct<node:string,ext_id:int>, step int, lo long, freq long, text string, done boolean").parquet(steps))


def contigs(steps: DataFrame) -> DataFrame:
    """(contig) of the walks that ended: the texts of the steps whose part of the visits holds theirs, in order."""
    ends = steps.where("done").select(F.col("seed").alias("_seed"), F.col("lo").alias("_lo"), F.col("step").alias("_last"))
    held = steps.join(ends, (F.col("seed") == F.col("_seed")) & (F.col("lo") <= F.col("_lo")) & (F.col("_lo") < F.col("lo") + F.col("freq")) & (F.col("step") <= F.col("_last")))
    walked = held.groupBy("_seed", "_lo", "_last").agg(F.sum(F.length("text")).alias("n"), F.sort_array(F.collect_list(F.struct("step", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return walked.select(F.when(F.col("n") < MOST, text).otherwise(F.raise_error(F.lit("a contig grew too long")).cast("string")).alias("contig"))

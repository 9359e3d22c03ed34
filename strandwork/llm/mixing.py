"""Operator 1: mixing sources to target weights by pivotal dependent rounding.

A source that shall give ``target`` words out of ``source_size`` gives every document target / source_size
copies: a whole part, and a fraction that has to be rounded. Documents with a fraction meet in blocks of about
FAN, and a block is folded pair by pair: words (not probabilities) are moved at random from one document of the
pair to the other until one of the two fractions is 0 or 1; the other goes on to the next pair. A block's last
document goes on to a block of the next level, up to one document of each source. Moving words keeps a source's
expected words exactly, whatever the documents' lengths; the sum is off by the rounding of that one document.
The direction has the odds that leave each document's expected copies as they were. A block goes from long to
short documents, so that the one that is left over is rather a short one.

Blocks are dealt by a hash of the document, so a source that holds most rows has more blocks, not larger ones.
Randomness is a hash of seed, level and pair: reruns agree.

Cases: a null text, and one without words, has size 0 and takes part in nothing, so it has no copies; a null source is a source, the
last one; a null doc_id is a value like others; rows equal in doc_id, text and source share one decision; a very long
text is a unit like others; ties of size in a block go by the hash; an empty table gives an empty result; mixed() hands on
all columns, whatever their names, and mix() reads three. Sources are a small table (ranks and targets are computed in one
task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

FAN = 128
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Sources are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_src, source, n_docs, source_size, target) from (source, n_docs, source_size).

    Targets are least(most * size, level * weight) with the level at which they add up. With sources by rising
    most * size / weight, the level that is due if all before one are at their limit rises up to the first
    source that isn't, and falls after it: the level is the largest of these."""
    everything = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumn("_src", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_src") - 1, F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    rising = everything.orderBy(F.col("_cap") / F.col("_w"), "_src")
    full = F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1))
    open_weight = F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    due = (share * F.sum("source_size").over(everything) - F.coalesce(full, F.lit(0.0))) / open_weight
    level = F.max("_due").over(everything)
    return ranked.withColumn("_due", due).select("_src", "source", "n_docs", "source_size", F.least("_cap", level * F.col("_w")).alias("target"))


def _uniform(seed: int, level: int, *cols: Column) -> Column:
    h = F.xxhash64(F.lit(seed), F.lit(level), *cols)
    return F.call_function("shiftrightunsigned", h, F.lit(11)) / F.lit(float(1 << 53))


def _fold(units: Column, seed: int, level: int) -> Column:
    """struct(i, p, out): the unit that is left with its fraction, and (i, up) of the others."""

    def step(s: Column, j: Column) -> Column:
        a, b, p, q = units[s["i"]]["a"], units[j]["a"], s["p"], units[j]["p"]
        up, down = F.least((1 - p) * a, q * b), F.least(p * a, (1 - q) * b)
        rise = _uniform(seed, level, units[s["i"]]["h"], units[j]["h"]) * (up + down) < down
        first_done = F.when(rise, (1 - p) * a <= q * b).otherwise(p * a <= (1 - q) * b)
        done_up = F.when(rise == first_done, 1).otherwise(0)
        left = F.when(rise, F.when(first_done, q - up / b).otherwise(p + up / a)).otherwise(F.when(first_done, q + down / b).otherwise(p - down / a))
        done = F.struct(F.when(first_done, s["i"]).otherwise(j).alias("i"), done_up.alias("up"))
        return F.struct(
            F.when(first_done, j).otherwise(s["i"]).alias("i"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("p"), F.concat(s["out"], F.array(done)).alias("out")
        )

    start = F.struct(F.lit(0).alias("i"), units[0]["p"].alias("p"), F.array().cast("array<struct<i:int,up:int>>").alias("out"))
    rest = F.when(F.size(units) > 1, F.sequence(F.lit(1), F.size(units) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, start, step)


def pivotal(units: DataFrame, most_blocks: int, seed: int = 0) -> DataFrame:
    """(u, up) for (src, block, blocks, u): u is a struct that begins with o = -a and h, by which a block is
    sorted, and has a (mass) and p (fraction strictly between 0 and 1); block < blocks, which a source's units share; most_blocks: the largest of those.
    up is 1 or 0."""
    decided, level = [], 0
    kind = units.schema["u"].dataType.simpleString()
    while True:
        folded = units.groupBy("src", "block").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list("u")).alias("us"))
        folded = C.cut(folded.withColumn("f", _fold(F.col("us"), seed, level)))
        done = F.transform("f.out", lambda d: F.struct(F.col("us")[d["i"]].alias("u"), d["up"].alias("up")))
        decided.append(folded.select(F.explode(done).alias("d")).select("d.*"))
        left = F.col("us")[F.col("f.i")].withField("p", F.col("f.p")).cast(kind)
        units = folded.select("src", F.floor(F.col("block") / FAN).alias("block"), F.ceil(F.col("blocks") / FAN).alias("blocks"), left.alias("u"))
        level += 1
        if most_blocks <= 1:
            decided.append(units.select("u", F.when(_uniform(seed, level, F.col("u.h")) < F.col("u.p"), 1).otherwise(0).alias("up")))
            break
        most_blocks = -(-most_blocks // FAN)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 0, **rule) -> DataFrame:
    """One row per row of docs: doc_id, source, _tk (hash of the text), size, source_size, target, copies."""
    t = F.col(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(t).alias("_tk"), F.size(C.words_of(C.text_of(t))).cast("long").alias("size"))
    units = C.cut(rows.groupBy("doc_id", "source", "_tk", "size").agg(F.count(F.lit(1)).alias("_m")))
    by_source = C.cut(targets(units.groupBy("source").agg(F.sum("_m").alias("n_docs"), F.sum(F.col("size") * F.col("_m")).alias("source_size")), **rule))
    n_sources, most = by_source.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    small = F.broadcast(by_source) if n_sources <= BROADCAST_SOURCES else by_source
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    all_units = units.join(small.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_x", wanted)
    all_units = all_units.withColumn("_whole", F.floor(F.col("_x") + 1e-12).cast("long")).withColumn("_p", F.greatest(F.lit(0.0), F.col("_x") - F.col("_whole")))
    h = F.xxhash64(F.lit(seed), "doc_id", "_tk")
    kept = ["doc_id", "source", "_tk", "size", "_m", "source_size", "target", "_whole"]
    mass = (F.col("size") * F.col("_m")).cast("double")
    u = F.struct((-mass).alias("o"), h.alias("h"), mass.alias("a"), F.col("_p").alias("p"), *kept)
    blocks = F.ceil(F.col("n_docs") / FAN)
    split = (F.col("size") > 0) & (F.col("_p") > 1e-12)
    todo = all_units.where(split).select(F.col("_src").alias("src"), F.pmod(h, blocks).alias("block"), blocks.alias("blocks"), u.alias("u"))
    rounded = pivotal(todo, -(-(most or 1) // FAN), seed).select("u.*", "up").drop("o", "h", "a", "p")
    done = rounded.unionByName(all_units.where(~split).select(*kept, F.lit(0).alias("up")).withColumn("_whole", F.when(F.col("size") > 0, F.col("_whole")).otherwise(0)))
    one = done.withColumn("copies", F.col("_whole") + F.col("up")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_m"))))
    return one.select("doc_id", "source", "_tk", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **rule) -> DataFrame:
    """The mixture: every row of docs as often as the mix takes it, with the columns of docs."""
    plan = mix(docs, text, source, doc_id, **rule).select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), "_tk", "copies").distinct()
    rows = docs.select(C.packed(docs), F.col(doc_id).alias("_d"), F.col(source).alias("_s"), F.xxhash64(text).alias("_t"))
    same = (rows["_t"] == plan["_tk"]) & rows["_d"].eqNullSafe(plan["_doc"]) & rows["_s"].eqNullSafe(plan["_source"])
    taken = rows.join(plan.where("copies > 0"), same).select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_n"))
    return taken.select(*C.unpacked("_row", docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def target_query(spark, sf_dir: str) -> DataFrame:
    size = F.size(C.words_of(C.text_of("text"))).cast("long")
    sizes = C.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("source_size"))
    return targets(sizes).select("source", "n_docs", "source_size", (F.floor(F.col("target") * 1000 + F.lit(0.5000001)) / 1000.0).alias("target"))


#: The level is looked for as the one at which the targets add up: between the two limits where it must lie, they grow in
#: proportion.
TARGET_SQL = r"""
WITH s AS (
  SELECT source, count(*) AS n_docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source
), r AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, 2.0 * source_size AS cap FROM s
), steps AS (
  SELECT l.level, (SELECT sum(least(cap, l.level * w)) FROM r) AS given, (SELECT coalesce(sum(w) FILTER (WHERE cap > l.level * w), 0) FROM r) AS rate
  FROM (SELECT DISTINCT cap / w AS level FROM r UNION SELECT 0.0) l
), found AS (
  SELECT max_by(level + CASE WHEN rate > 0 THEN ((SELECT 1.5 * sum(source_size) FROM r) - given) / rate ELSE 0 END, level) AS level
  FROM steps WHERE given <= (SELECT 1.5 * sum(source_size) FROM r)
)
SELECT source, n_docs, source_size, floor(least(cap, (SELECT level FROM found) * w) * 1000 + 0.5000001) / 1000.0 AS target FROM r
"""

"""K-mers: windows, counts, histogram, cutoff, minimizers.

A window is a slice of the sequence as bytes, which costs its own length only; slicing strings would count code points
from the beginning for each. Windows are made in generated code and aggregated where they are made. For longer k, reads
travel as super-k-mers, dealt by their minimizer, and are only cut into windows where these are counted: a base is sent
about four times, not k times, and no second exchange is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encoding as E
from ..functions.superkmers import COUNTED, PACKED, counted, packed_super_kmers, super_kmers
from ..tables import cut, drop

#: From this k on, counts() deals super-k-mers by their minimizers of MINIMIZER bases; shorter k-mers are so few that
#: aggregating before the exchange leaves little to send.
LEAST = 20
MINIMIZER = 12
#: Up to this k a window is a 64-bit integer.
INTEGER = 32


def windows(reads: DataFrame, k: int, on_invalid: str = "split", name: str = "kmer") -> DataFrame:
    """(read_id, pos, kmer): every window of k bases of every read, as digits. A read of k bases has one."""
    digits = _clean(reads, k, on_invalid)
    # What a read costs is paid before its windows are made, in a projection of its own.
    digits = digits.select("read_id", F.col("_seq").cast("binary").alias("_bytes"), F.col("_seq").rlike("[^0-3]").alias("_mixed"), F.length("_seq").alias("_n"))
    placed = digits.select("read_id", "_bytes", "_mixed", F.explode(F.sequence(F.lit(0), F.col("_n") - k)).alias("pos"))
    out = placed.select("read_id", "pos", F.substring("_bytes", F.col("pos") + 1, F.lit(k)).cast("string").alias(name), "_mixed")
    if on_invalid == "split":  # only windows of reads that have other characters are looked through
        out = out.where(~F.col("_mixed") | ~F.col(name).rlike("[^0-3]"))
    return out.drop("_mixed")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a file of few row groups would be mapped by few tasks. What
    comes out of a shuffle stays as it is; to ask how many partitions that has would run it."""
    if df.isStreaming or df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _clean(reads: DataFrame, k: int, on_invalid: str) -> DataFrame:
    """(read_id, _seq): reads of k bases or more, as digits."""
    seq = {"split": F.col("seq"), "error": E.strict("seq"), "as_A": E.lenient("seq")}[on_invalid]
    return reads.select("read_id", E.encode(seq).alias("_seq")).where(F.length("_seq") >= k)


def _packed(digits: DataFrame, k: int, *kept: str) -> DataFrame:
    """(packed, *kept): every window of an even k of sequences of digits only, two bases to a byte, in the same order. A
    sequence is packed twice, from its first and from its second base; a window is then a slice of bytes of one of the
    two."""
    even = lambda start: F.unhex(F.substring("_seq", F.lit(start), F.call_function("div", F.length("_seq") - (start - 1), F.lit(2)).cast("int") * 2))
    halves = digits.select(even(1).alias("_even"), even(2).alias("_odd"), F.length("_seq").alias("_n"), *kept)
    placed = halves.select("_even", "_odd", F.explode(F.sequence(F.lit(0), F.col("_n") - k)).alias("_pos"), *kept)
    half = F.call_function("shiftright", "_pos", F.lit(1)) + 1
    return placed.select(F.substring(F.when(F.col("_pos").bitwiseAND(1) == 0, F.col("_even")).otherwise(F.col("_odd")), half, F.lit(k // 2)).alias("packed"), *kept)


def _few(reads: DataFrame, k: int, on_invalid: str, name: str) -> DataFrame:
    """counts() of short k-mers: windows, aggregated before and after an exchange on the k-mer."""
    if k % 2:
        return windows(reads, k, on_invalid, name).groupBy(name).agg(F.count(F.lit(1)).alias("cnt"))
    digits = _clean(reads, k, on_invalid).withColumn("_mixed", F.col("_seq").rlike("[^0-3]"))
    out = _packed(digits.where("NOT _mixed"), k)
    if on_invalid == "split":
        rest = digits.where("_mixed").select("read_id", E.decode("_seq").alias("seq"))
        out = out.unionByName(windows(rest, k).select(F.unhex("kmer").alias("packed")))
    return out.groupBy("packed").agg(F.count(F.lit(1)).alias("cnt")).select(F.hex("packed").alias(name), "cnt")


def _by_minimizer(reads: DataFrame, k: int, on_invalid: str, name: str) -> DataFrame:
    """counts() of k-mers that are longer than an integer. Super-k-mers meet by their bucket; grouping by (bucket, k-mer) asks for no other
    exchange, for all of a bucket is in one partition."""
    made = _clean(reads, k, on_invalid).select("_seq").mapInArrow(super_kmers(k, MINIMIZER), "bucket long, seq string, n long")
    dealt = made.repartition(F.col("bucket")).withColumnRenamed("seq", "_seq")
    if k % 2:
        placed = dealt.select("bucket", "n", F.col("_seq").cast("binary").alias("_b"), F.explode(F.sequence(F.lit(0), F.length("_seq") - k)).alias("_pos"))
        out = placed.select("bucket", "n", F.substring("_b", F.col("_pos") + 1, F.lit(k)).alias("packed"))
        text = F.col("packed").cast("string")
    else:
        out, text = _packed(dealt, k, "bucket", "n"), F.hex("packed")
    return out.groupBy("bucket", "packed").agg(F.sum("n").alias("cnt")).select(text.alias(name), "cnt")


def _as_integers(reads: DataFrame, k: int, on_invalid: str, least: int | None = 1, num_buckets: int = 0) -> DataFrame:
    """COUNTED: k-mers, up to INTEGER bases, that occur least times or more, and the histogram of all; see counted()."""
    made = _clean(reads, k, on_invalid).select("_seq").mapInArrow(packed_super_kmers(k, MINIMIZER), PACKED)
    return made.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(counted(k, least, num_buckets), COUNTED)


def counts(reads: DataFrame, k: int, on_invalid: str = "split", name: str = "kmer") -> DataFrame:
    """(kmer, cnt): exact counts. K-mers are packed while they are aggregated: two bases to a byte (for an even k), or, where
    super-k-mers are sent, up to 32 bases as an integer."""
    if k < LEAST or reads.isStreaming:
        return _few(spread(reads), k, on_invalid, name)
    if k <= INTEGER:
        return _as_integers(spread(reads), k, on_invalid).select(F.col("kmer").alias(name), "cnt")
    return _by_minimizer(spread(reads), k, on_invalid, name)


def totals(kmer_counts: DataFrame) -> DataFrame:
    """One row: distinct k-mers, all k-mers, and the range of counts."""
    return kmer_counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_total"), F.min("cnt").alias("min_cnt"), F.max("cnt").alias("max_cnt"))


def histogram(kmer_counts: DataFrame, num_buckets: int = 21) -> DataFrame:
    """(bucket, n) for buckets 1 to num_buckets - 1: how many k-mers occur exactly so often; 0 for none."""
    return _buckets(kmer_counts.where(F.col("cnt") < num_buckets).groupBy("cnt").agg(F.count(F.lit(1)).alias("n")), num_buckets)


def _buckets(found: DataFrame, num_buckets: int) -> DataFrame:
    """(bucket, n) of what was found (cnt, n)."""
    buckets = found.sparkSession.range(1, num_buckets).select(F.col("id").alias("bucket"))
    return buckets.join(F.broadcast(found), F.col("bucket") == F.col("cnt"), "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cutoff(buckets: DataFrame) -> DataFrame:
    """One row: the bucket with fewest k-mers, of equal ones the first."""
    return buckets.agg(F.min(F.struct("n", "bucket")).alias("m")).select(F.col("m.bucket").alias("cutoff"), F.col("m.n").alias("n"))


def solid(kmer_counts: DataFrame, least: int) -> DataFrame:
    """K-mers that occur at least so often."""
    return kmer_counts.where(F.col("cnt") >= least)


def solid_of(reads: DataFrame, k: int, least: int | None, num_buckets: int, on_invalid: str = "split") -> DataFrame:
    """K-mers of reads that occur at least so often; where least is None, as often as the histogram's cutoff. Most k-mers
    occur a few times only, and only the histogram needs them: those that are surely under the cutoff aren't written. Should
    the cutoff be lower than a task took it to be, k-mers are counted once more, with it known."""
    if k < LEAST or k > INTEGER:
        found = cut(counts(reads, k, on_invalid))
        return solid(found, cutoff(histogram(found, num_buckets)).first()["cutoff"] if least is None else least)
    made = cut(_as_integers(spread(reads), k, on_invalid, least, 0 if least else num_buckets))
    if least is None:
        found = made.where("kmer IS NULL")
        least = cutoff(_buckets(found.where("cnt > 0").groupBy("cnt").agg(F.sum("n").alias("n")), num_buckets)).first()["cutoff"]
        if found.where((F.col("cnt") == 0) & (F.col("n") > least)).limit(1).count():
            drop(made)
            made = cut(_as_integers(spread(reads), k, on_invalid, least))
    return solid(made.where("kmer IS NOT NULL").select("kmer", "cnt"), least)


def minimizers(kmers: DataFrame, lmer_freq: DataFrame, k: int, l: int) -> DataFrame:  # noqa: E741
    """(kmer, minimizer): each k-mer's least frequent l-mer, of equal ones the leftmost. lmer_freq (lmer, freq) has at
    most 4 ** l rows: up to 16 MB at l = 8 or less it is broadcast."""
    small = F.broadcast(lmer_freq) if l <= 8 else lmer_freq
    parts = kmers.select("kmer", F.col("kmer").cast("binary").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(k - l))).alias("_pos"))
    parts = parts.select("kmer", "_pos", F.substring("_b", F.col("_pos") + 1, F.lit(l)).cast("string").alias("lmer"))
    least = F.min(F.struct("freq", "_pos", "lmer")).alias("m")
    return parts.join(small, "lmer").groupBy("kmer").agg(least).select("kmer", F.col("m.lmer").alias("minimizer"))


def minimizer_load(with_minimizer: DataFrame, partitions: int) -> DataFrame:
    """(partition, n_kmers, n_instances): what each partition gets if a k-mer goes to its minimizer's hash."""
    part = E.hash_partition(E.number("minimizer"), partitions).alias("partition")
    return with_minimizer.groupBy(part).agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("cnt").alias("n_instances"))


def partition_load(kmer_counts: DataFrame, part: Column) -> DataFrame:
    return kmer_counts.groupBy(part.alias("partition")).agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("cnt").alias("n_instances"))


def running_total(df: DataFrame, by: list[str], order: list[Column], value: str) -> Column:
    """The exclusive prefix sum of value."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(w) - F.col(value)

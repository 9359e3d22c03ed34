"""From reads to contigs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AssemblyConfig
from ..operators import compaction, graph, kmers
from ..operators.walk import walk
from ..tables import cut


@dataclass
class Assembly:
    """What an assembly made: counts and cutoff, the graph as built and as compacted, rounds and the seconds they took,
    partial contigs; and contigs as digits, which are walked when they are first asked for."""

    kmer_counts: DataFrame
    cutoff: int
    graph: DataFrame
    compacted: DataFrame
    rounds: list[tuple[int, int, int]]
    seconds: list[float]
    partial: DataFrame
    config: AssemblyConfig

    @cached_property
    def contigs(self) -> DataFrame:
        """(contig, len, source): partial contigs, and those of walks."""
        walked = walk(self.compacted, self.config.k, self.config.walk_mode)
        found = self.partial.withColumn("source", F.lit("partial")).unionByName(walked.withColumn("source", F.lit("walk")))
        return found.select("contig", F.length("contig").alias("len"), "source")

    def stats(self) -> DataFrame:
        """One row of figures: k-mers, nodes before and after, rounds, contigs by where they come from."""
        spark = self.graph.sparkSession
        totals = kmers.totals(self.kmer_counts).select("n_distinct", "n_total")
        built = graph.nodes(self.graph).agg(F.count(F.lit(1)).alias("n_nodes"))
        left = graph.nodes(self.compacted).agg(F.count(F.lit(1)).alias("n_left"))
        of = lambda source: F.count_if(F.col("source") == source).alias(f"n_{source}")
        lengths = self.contigs.agg(of("walk"), of("partial"), F.max("len").cast("long").alias("longest"))
        fixed = spark.range(1).select(F.lit(self.cutoff).cast("long").alias("cutoff"), F.lit(len(self.rounds)).cast("long").alias("n_rounds"))
        return fixed.crossJoin(totals).crossJoin(built).crossJoin(left).crossJoin(lengths)

    def round_figures(self) -> DataFrame:
        """(round, n_nodes, n_chosen, n_messages, seconds) of compaction, seconds by the clock."""
        rows = [(i, *r, s) for i, (r, s) in enumerate(zip(self.rounds, self.seconds, strict=True), 1)]
        return self.graph.sparkSession.createDataFrame(rows, "round int, n_nodes long, n_chosen long, n_messages long, seconds double")


def cutoff_of(kmer_counts: DataFrame, config: AssemblyConfig) -> int:
    """The configured cutoff, or that of the histogram."""
    if config.cutoff is not None:
        return config.cutoff
    return kmers.cutoff(kmers.histogram(kmer_counts, config.num_buckets)).first()["cutoff"]


def solid_kmers(reads: DataFrame, config: AssemblyConfig) -> DataFrame:
    """K-mers that reach the cutoff."""
    return kmers.solid_of(reads, config.k, config.cutoff, config.num_buckets, config.on_invalid)


def assemble(reads: DataFrame, config: AssemblyConfig) -> Assembly:
    found = cut(kmers.counts(reads, config.k, config.on_invalid))
    least = cutoff_of(found, config)
    solid = kmers.solid(found, least)
    if not solid.limit(1).count():
        raise ValueError(f"no k-mer occurs {least} times")
    built = cut(graph.build(solid, config.k, config.coverage))
    seconds: list[float] = []
    compacted, partial, rounds = compaction.compact(built, config.k, config.node_threshold, seconds=seconds)
    return Assembly(found, least, built, compacted, rounds, seconds, partial, config)

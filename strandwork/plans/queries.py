"""The library's queries on the driver's tables: documents, as reads; lineitem and orders, for sorting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AssemblyConfig
from ..functions import encoding as E
from ..operators import compaction, graph, kmers, sorting, walk, wiring
from ..sources import logs
from ..sources import reads as R
from ..streaming.counting import DOCUMENTS, count_stream
from ..tables import cut, new_path
from . import assembly

CONFIG = AssemblyConfig(coverage=10)
#: For compaction: a lower cutoff makes a graph that has something to compact.
COMPACTED = AssemblyConfig(coverage=10, cutoff=5, node_threshold=500)
PARTITIONS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.from_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.counts(reads(spark, sf_dir), CONFIG.k)


def _lmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.counts(reads(spark, sf_dir), CONFIG.l, name="lmer").withColumnRenamed("cnt", "freq")


def _solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.solid_kmers(reads(spark, sf_dir), CONFIG)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(graph.build(_solid(spark, sf_dir), CONFIG.k, CONFIG.coverage))


def _bases(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: E.decode(n) for n in names})


def _base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = kmers.counts(reads(spark, sf_dir), 1, name="base")
    return _bases(each, "base").withColumnRenamed("cnt", "n")


def _kmers_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", F.greatest(F.length("seq").cast("long") - CONFIG.k + 1, F.lit(0).cast("long")).alias("n_kmers"))


def _minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    solid = cut(_solid(spark, sf_dir))
    return kmers.minimizers(solid, _lmers(spark, sf_dir), CONFIG.k, CONFIG.l).join(solid, "kmer")


def _lmer_load(part: Callable) -> Callable:
    return lambda spark, sf_dir: kmers.partition_load(_lmers(spark, sf_dir).withColumnRenamed("freq", "cnt"), part(E.number("lmer")))


def _macro_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda s: F.count_if((F.col("side") == s) & ~F.col("terminal"))
    return _graph(spark, sf_dir).groupBy("node").agg(side("P").alias("n_prefixes"), side("S").alias("n_suffixes"))


def _invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = _graph(spark, sf_dir)
    return wiring.invariants(ext, wiring.wires(ext))


def _round(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ext = _graph(spark, sf_dir)
    chosen = cut(compaction.independent_set(ext, CONFIG.k))
    return ext, chosen, compaction.paths_through(ext, chosen, CONFIG.k)


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.transfers(_round(spark, sf_dir)[2])


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.partial_contigs(_round(spark, sf_dir)[2])


def _compact_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext, chosen, paths = _round(spark, sf_dir)
    return compaction.apply_transfers(ext, chosen, cut(compaction.transfers(paths))).drop("ext_id")


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk(_graph(spark, sf_dir), CONFIG.k, CONFIG.walk_mode)


def _written(spark: SparkSession, lines: DataFrame) -> str:
    """The folder of text files that hold lines (value)."""
    path = new_path(spark)
    lines.write.text(path)
    return path


def _fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads, written as FASTA, read back."""
    made = reads(spark, sf_dir).where(F.length("seq") > 0)
    return R.fasta(spark, _written(spark, R.fasta_lines(made))).select("header", "seq")


def _fasta_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and total k-mers of a FASTA file."""
    made = reads(spark, sf_dir).where(F.length("seq") > 0)
    return kmers.totals(kmers.counts(R.fasta(spark, _written(spark, R.fasta_lines(made))), CONFIG.k))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a bar after each, two to a line, read back as records."""
    names = _table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("|"), "c_mktsegment", F.lit("||")).alias("value"))
    path = new_path(spark)
    names.write.option("lineSep", "|").text(path)
    return R.records(spark, path, "|")


def _contig_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of more than 33 bases, written and read back."""
    made = _walks(spark, sf_dir).select("contig", F.length("contig").alias("len"), F.lit("walk").alias("source"))
    path = new_path(spark)
    R.write_contigs(made, path, min_len=33)
    return R.fasta(spark, path).select("header", "seq")


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as an assembler prints them, of made-up runs: a file for each region, a round for each nation."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    line = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    rounds = line("Itr: ", F.col("k"), ", Total number of macro_nodes across all proc's: ", 1000 - F.col("k"), " [min=1]")
    heads = n.groupBy("r").agg(F.sum("k").alias("s")).select("r", F.lit(-1).alias("k"), line("Total number of reads: ", F.col("s"), "\n[elapsed-time-no-io]: ", F.col("r"), ".25").alias("value"))
    return heads.unionByName(n.select("r", "k", rounds.alias("value"))).repartition(1, "r").sortWithinPartitions("r", "k")


def _logs(spark: SparkSession, sf_dir: str, read: Callable) -> DataFrame:
    path = new_path(spark)
    _log_lines(spark, sf_dir).select(F.col("r").alias("run"), "value").write.partitionBy("run").text(path)
    return read(spark, path)


def _lmer_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each l-mer's first base as a code, the l-mer after one more base, its third base."""
    found = _lmers(spark, sf_dir)
    return found.select(
        E.decode("lmer").alias("lmer"), E.base_code(E.decode(F.substring("lmer", 1, 1))).cast("int").alias("code"), E.decode(E.shifted("lmer", F.lit("3"), CONFIG.l)).alias("shifted"),
        E.decode(E.base_at("lmer", 2)).alias("third"), E.strict(F.lower(E.decode("lmer"))).alias("strict"),
    )


def _lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_name", E.lenient("n_name").alias("bases"), E.base_code("n_name").cast("int").alias("code"))


def _node_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dump(_graph(spark, sf_dir))


def _round_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assemble(reads(spark, sf_dir), COMPACTED).round_figures().drop("seconds")


def _partial_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(assembly.assemble(reads(spark, sf_dir), COMPACTED).partial, "contig")


def _compacted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assemble(reads(spark, sf_dir), COMPACTED).compacted


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assemble(reads(spark, sf_dir), COMPACTED).stats()


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(assembly.assemble(reads(spark, sf_dir), COMPACTED).contigs, "contig")


def default_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contigs of an assembly as it runs without being told more than the coverage."""
    return _bases(assembly.assemble(reads(spark, sf_dir), CONFIG).contigs, "contig")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, for the source takes folders and patterns, not the name of one file.
    found = count_stream(spark, f"{sf_dir}/documents.parque[t]", CONFIG.l, DOCUMENTS)
    return found.select(E.decode("kmer").alias("lmer"), F.col("cnt").alias("freq"))


def _byte_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sorting.shuffle_by_byte(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0, 4)
    return dealt.groupBy("processor").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_stats": lambda s, d: R.read_stats(reads(s, d), CONFIG.k),
    "kmers_per_read": _kmers_per_read,
    "base_counts": _base_counts,
    "lmer_freq": lambda s, d: _bases(_lmers(s, d), "lmer"),
    "streaming_lmer_freq": _stream,
    "kmer_counts": lambda s, d: _bases(_counts(s, d), "kmer"),
    "kmer_totals": lambda s, d: kmers.totals(_counts(s, d)),
    "kmer_histogram": lambda s, d: kmers.histogram(_counts(s, d), CONFIG.num_buckets),
    "abundance_cutoff": lambda s, d: kmers.cutoff(kmers.histogram(_counts(s, d), CONFIG.num_buckets)),
    "solid_kmers": lambda s, d: _bases(_solid(s, d), "kmer"),
    "minimizers": lambda s, d: _bases(_minimizers(s, d).select("kmer", "minimizer"), "kmer", "minimizer"),
    "minimizer_load": lambda s, d: kmers.minimizer_load(_minimizers(s, d), PARTITIONS),
    "hash31_partition_load": _lmer_load(lambda x: E.hash_partition(x, PARTITIONS)),
    "range_partition_load": _lmer_load(lambda x: E.range_partition(x, CONFIG.l, PARTITIONS)),
    "node_extensions": _graph,
    "macro_nodes": _macro_nodes,
    "base_pivot": lambda s, d: graph.base_pivot(_graph(s, d)),
    "threshold_nodes": lambda s, d: graph.meets_threshold(graph.base_pivot(_graph(s, d)), 30).select("node"),
    "neighbors": lambda s, d: graph.neighbors(_graph(s, d), CONFIG.k),
    "node_balance": lambda s, d: graph.balance(_graph(s, d)),
    "wires": lambda s, d: wiring.wires(_graph(s, d)),
    "wire_invariants": _invariants,
    "independent_set": lambda s, d: compaction.independent_set(_graph(s, d), CONFIG.k),
    "transfers_round1": _transfers,
    "partial_contigs_round1": _partial,
    "compact_round1": _compact_round,
    "begin_nodes": lambda s, d: graph.begin_nodes(_graph(s, d)),
    "walk_contigs": lambda s, d: _bases(_walks(s, d), "contig"),
    "contig_lengths": lambda s, d: _walks(s, d).groupBy(F.length("contig").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n")),
    "assembly_compacted": _compacted,
    "compacted_graph": _compacted_graph,
    "partial_contigs": _partial_contigs,
    "round_figures": _round_figures,
    "assembly_stats": _stats,
    "node_dump": _node_dump,
    "fasta_reads": _fasta,
    "fasta_totals": _fasta_totals,
    "delimited_records": _records,
    "contig_records": _contig_records,
    "log_figures": lambda s, d: _logs(s, d, logs.figures).select("round", "label", "value"),
    "log_runs": lambda s, d: _logs(s, d, logs.runs).drop("file"),
    "lmer_functions": _lmer_functions,
    "lenient_bases": _lenient,
    "sorted_keys": lambda s, d: sorting.sort_integers(_table(s, d, "lineitem"), "l_partkey", remove_duplicates=True),
    "most_significant_bit": lambda s, d: sorting.most_significant_bit(_table(s, d, "orders"), "o_orderkey"),
    "byte_shuffle_load": _byte_shuffle,
}

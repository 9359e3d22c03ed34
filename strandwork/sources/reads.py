"""Reads: FASTA files, records with any delimiter, documents; and contig files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoding as E


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(record): the non-empty parts of text files between delimiters. Files are split between tasks, and a record
    belongs to the task in whose part it begins."""
    return spark.read.text(path, lineSep=delimiter).select(F.col("value").alias("record")).where(F.length("record") > 0)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, header, seq). A record is a line that begins with '>', its header, and one sequence line, or several,
    which are joined; a '>' inside a line is part of it. read_id is a number of the record, unique within the result but
    not without gaps, and the same while files and their splits are."""
    r = records(spark, path, "\n>").where(F.length(F.trim("record")) > 0)
    lines = F.split(F.regexp_replace("record", "^>|\r$", ""), "\r?\n")
    return r.select(F.monotonically_increasing_id().alias("read_id"), lines[0].alias("header"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("seq"))


def fasta_lines(reads: DataFrame) -> DataFrame:
    """(value): the FASTA records of reads."""
    return reads.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"))


def from_documents(docs: DataFrame) -> DataFrame:
    """(read_id, header, seq): each document's letters as bases."""
    return docs.select(F.col("doc_id").alias("read_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("header"), E.letters_to_bases(F.coalesce("text", F.lit(""))).alias("seq"))


def shred(reads: DataFrame, length: int = 100, stride: int = 50) -> DataFrame:
    """Reads of one length cut from longer ones, every ``stride`` bases; what is left at an end makes no read."""
    long = reads.where(F.length("seq") >= length).withColumn("_seq", F.col("seq").cast("binary"))
    at = long.select("read_id", "header", "_seq", F.explode(F.sequence(F.lit(0), F.length("seq") - length, F.lit(stride))).alias("_at"))
    piece = F.substring("_seq", F.col("_at") + 1, F.lit(length)).cast("string")
    return at.select(F.struct("read_id", "_at").alias("read_id"), F.concat_ws("_", "header", F.col("_at").cast("string")).alias("header"), piece.alias("seq"))


def read_stats(reads: DataFrame, k: int) -> DataFrame:
    """One row: reads, bases, shortest and longest read, and how many k-mers the reads have."""
    n = F.length("seq").cast("long")
    return reads.agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum(n).alias("n_bases"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.sum(F.greatest(n - k + 1, F.lit(0).cast("long"))).alias("n_kmers")
    )


def contig_lines(contigs: DataFrame, min_len: int = 400) -> DataFrame:
    """(value): FASTA records of the contigs (as digits) that are longer than min_len."""
    kept = contigs.where(F.col("len") > min_len)
    name = F.concat(F.lit(">contig_"), F.substring(F.sha2("contig", 256), 1, 16), F.lit("_l_"), F.col("len").cast("string"), F.lit("_"), F.col("source"))
    return kept.select(F.concat(name, F.lit("\n"), E.decode("contig")).alias("value"))


def write_contigs(contigs: DataFrame, path: str, min_len: int = 400) -> None:
    contig_lines(contigs, min_len).write.text(path)

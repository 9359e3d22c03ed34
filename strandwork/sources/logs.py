"""Run logs as tables: what an assembler printed, one row for each figure, and one for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wordings in the logs of runs: fixed values. A figure's label begins with, or has, this text.
LABELS = {
    "n_reads": "Total number of reads",
    "n_processes": "Number of Processes",
    "n_distinct": "Total distinct k-mer entries",
    "counting_s": "Average time for performing k-mer counting",
    "nodes": "Total number of macro_nodes",
    "elapsed_s": "elapsed-time-no-io",
}


def figures(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, round, label, value): every 'label: number' of text files; round where the label names one."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")
    found = lines.select("path", "file", F.explode(F.regexp_extract_all("value", F.lit(r"([^:]+:\s*[-+]?\d+(?:\.\d+)?)(?![\w.])"), F.lit(1))).alias("pair"), "value")
    found = found.select(
        "path", "file", F.try_element_at(F.regexp_extract_all("value", F.lit(r"(?i)itr: (\d+)"), F.lit(1)), F.lit(1)).cast("int").alias("round"),
        F.trim(F.regexp_replace(F.regexp_extract("pair", r"^([^:]+):", 1), r"^[\s,]*\d*[\s,]*", "")).alias("label"), F.regexp_extract("pair", r":\s*([-+]?\d+(?:\.\d+)?)$", 1).cast("double").alias("value"),
    )
    return found.where("label <> ''")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: the figures of LABELS; of nodes those of the first and the last round."""
    every = figures(spark, path)
    named = lambda text: F.col("label").contains(text)
    one = [F.max(F.when(named(text), F.col("value"))).alias(name) for name, text in LABELS.items() if name != "nodes"]
    at = F.when(named(LABELS["nodes"]) & F.col("round").isNotNull(), F.struct("round", "value"))
    return every.groupBy("path", "file").agg(*one, F.min(at).alias("a"), F.max(at).alias("b")).select(
        "file", *[n for n in LABELS if n != "nodes"], F.col("a.value").alias("first_nodes"), F.col("b.value").alias("last_nodes"), F.col("b.round").alias("n_rounds")
    )

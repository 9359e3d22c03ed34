"""Counts that follow a stream of documents: an aggregation without watermark, as k-mers never expire.

Batches add the k-mers they changed to one table; every FOLD batches it is folded to the last number of each k-mer, so
neither files nor plans grow with the number of batches. A batch that is tried again adds equal rows, which the fold
takes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import kmers
from ..sources.reads import from_documents
from .. import tables

#: Batches after which the table is folded.
FOLD = 50
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def running_counts(documents: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) of a stream of documents so far; output mode update or complete."""
    return kmers.counts(from_documents(documents), k)


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kmer").agg(F.max(F.struct("_batch", "cnt")).alias("m")).select("kmer", "m.*")


def count_stream(spark: SparkSession, path: str, k: int, schema: str | StructType = DOCUMENTS, files_per_batch: int = 1) -> DataFrame:
    """(kmer, cnt) after all files that are there now. Each batch sends the k-mers it changed; the last number of each
    is its count."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    at = tables.new_path(spark)
    kept = "kmer string, _batch long, cnt long"

    def keep(changed: DataFrame, batch: int) -> None:
        nonlocal at
        tables.write(changed.select("kmer", F.lit(batch).cast("long").alias("_batch"), "cnt"), at)
        if batch % FOLD == FOLD - 1:
            old, at = at, tables.new_path(spark)
            tables.write(_last(spark.read.schema(kept).parquet(old)), at)
            tables.delete(spark, old)

    writer = running_counts(stream, k).writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
    writer.option("checkpointLocation", tables.new_path(spark)).start().awaitTermination()
    found = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):  # no batch came
        return spark.createDataFrame([], "kmer string, cnt long")
    return _last(spark.read.schema(kept).parquet(at)).select("kmer", "cnt")

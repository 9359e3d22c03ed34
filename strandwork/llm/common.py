"""What the text operators share: columns for words and lines, hashes, and cutting lineage.

Words are maximal runs of code points outside ``[\\x20\\x09-\\x0D]``, as the contracts have them.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables

#: The white space of the contracts.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Files of a table, for each core.
FILES = 2

#: Bytes of an Arrow batch.
BATCH = 4 << 20

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_files(df: DataFrame) -> DataFrame:
    """df in at most an eighth as many partitions as a shuffle has, or FILES for each core of the cluster if that is
    more: what is written from many small ones costs more to create, and later to open, than to read."""
    spark = df.sparkSession
    return df.coalesce(max(FILES * spark.sparkContext.defaultParallelism, partitions(spark) // 8))


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, so a lost
    executor costs no more than its own tasks, and what depends on row order is settled once. free: after it,
    let Spark delete the shuffle files that led there; it does so once its driver's memory has been collected,
    which takes two rounds and would else happen at some later time."""
    spark = df.sparkSession
    path = tables.new_path(spark)
    few_files(df).write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    for _ in range(2 * free):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.15)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that cut() wrote. Frames built on them can't be read any more."""
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session has ended
            tables.delete(spark, path)
        _written.pop(path, None)


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that cut() returned and nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            tables.delete(df.sparkSession, path)
            _written.pop(path, None)


atexit.register(release)


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python about BATCH bytes at a time, where the session doesn't say otherwise: ten thousand texts, the
    default, are a batch in the JVM, one in Python and what is made of it, for each core."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: Column | str) -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(col: Column) -> Column:
    """The words of a text that isn't null."""
    even = F.translate(col, BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(even, " "), "")


def two_hashes(*cols: Column) -> list[Column]:
    """128 bits, as two columns."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of a row as one struct, whatever their names."""
    return F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias(name)


def unpacked(name: str, columns: list[str]) -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in columns]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

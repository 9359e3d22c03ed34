"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, in one process, as in tests, one of our own; on a cluster
    that is an error, for what one machine holds in such a folder the others don't see."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandwork/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write(df: DataFrame, path: str) -> None:
    """Add df to a table, in few files: rounds on a shrinking graph would else make many that hold next to nothing."""
    spark = df.sparkSession
    files = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    df.coalesce(files).write.mode("append").parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write df and read it back: what follows starts from files, so that loops don't grow their plans and a lost
    executor costs its own tasks only."""
    path = new_path(df.sparkSession)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() made. Frames built on them can't be read any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)

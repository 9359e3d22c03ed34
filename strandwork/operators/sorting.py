"""Sorting and dealing out integers: by range, by most significant byte, with or without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import byte_digit, top_bit


def sort_integers(df: DataFrame, column: str, remove_duplicates: bool = False) -> DataFrame:
    """The integers in global order: a range exchange, then sorted runs."""
    values = df.select(column)
    return (values.distinct() if remove_duplicates else values).orderBy(column)


def most_significant_bit(df: DataFrame, column: str) -> DataFrame:
    """One row: byte and bit of the most significant bit that is set in any value."""
    top = F.max(top_bit(F.col(column))).alias("b")
    return df.agg(top).select(F.floor(F.col("b") / 8).cast("int").alias("byte_index"), F.pmod(F.col("b"), F.lit(8)).cast("int").alias("bit_index"))


def bucket_of(value: Column, byte: int, processors: int) -> Column:
    """The processor of a value's bucket, which is its byte: min(bucket / ceil(256 / processors), processors - 1)."""
    per = -(-256 // processors)
    return F.least(F.floor(byte_digit(value, byte, byte + 1) / per), F.lit(processors - 1)).cast("int")


def shuffle_by_byte(df: DataFrame, column: str, byte: int, processors: int) -> DataFrame:
    """The rows with their processor, dealt out by it and sorted there."""
    dealt = df.withColumn("processor", bucket_of(F.col(column), byte, processors))
    return dealt.repartitionByRange(processors, "processor").sortWithinPartitions("processor", column)

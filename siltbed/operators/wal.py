"""The write-ahead log: segments, checksums, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kv import newest


def with_segment(log: DataFrame, size: int) -> DataFrame:
    return log.withColumn("segment", F.floor((F.col("lsn") - 1) / size))


def segments(log: DataFrame, size: int) -> DataFrame:
    """segment, n, min_lsn, max_lsn."""
    return with_segment(log, size).groupBy("segment").agg(F.count("*").alias("n"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"))


def dump(log: DataFrame, size: int) -> DataFrame:
    """All records in the order they were written."""
    return with_segment(log, size).orderBy("segment", "lsn")


def _crc() -> Column:
    """The checksum of a record's text `ts,tomb,k,v`."""
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ts_us", "tomb", "k", "v"))
    return F.crc32(F.concat_ws(",", *parts).cast("binary"))


def encode(log: DataFrame) -> DataFrame:
    """The log with crc, as it is written."""
    return log.withColumn("crc", _crc())


def checksums(log: DataFrame) -> DataFrame:
    """lsn, crc of each record."""
    return encode(log).select("lsn", "crc")


def verify(stored: DataFrame) -> DataFrame:
    """lsn, ok: whether each stored record still has the checksum that it was written with."""
    return stored.select("lsn", F.when(_crc() == F.col("crc"), 1).otherwise(0).alias("ok"))


def current_segment(log: DataFrame, size: int) -> DataFrame:
    """segment, n: the last segment and its records."""
    return segments(log, size).agg(F.max(F.struct("segment", "n")).alias("s")).select("s.segment", "s.n")


def replay(log: DataFrame, size: int, after: int) -> DataFrame:
    """k, v, tomb: the segments from `after` on, applied to the state of those before (an extension)."""
    cut = with_segment(log, size)
    state = newest(cut.where(F.col("segment") < after)).withColumn("lsn", F.lit(0).cast("long"))
    return newest(state.unionByName(cut.where(F.col("segment") >= after).drop("segment"))).select("k", "v", "tomb")

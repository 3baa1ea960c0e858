"""Put, delete and read over a log: the newest version of a key wins.

A read filters on the key before the versions are aggregated, so the filter reaches the scan;
filters on value or tombstone come after, or an older version would show again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with rows (k, v, ts_us, lsn) appended as writes."""
    return log.unionByName(rows.withColumn("tomb", F.lit(0)))


def newest(log: DataFrame) -> DataFrame:
    """k, v, ts_us, tomb: each key's newest version, deleted ones included. One shuffle of partial maxima."""
    best = F.max_by(F.struct("v", "ts_us", "tomb"), F.struct("ts_us", "lsn")).alias("s")
    return log.groupBy("k").agg(best).select("k", "s.v", "s.ts_us", "s.tomb")


def upsert(log: DataFrame) -> DataFrame:
    """k, v, n_versions of the keys written."""
    writes = log.where("tomb = 0")
    return writes.groupBy("k").agg(F.max_by("v", F.struct("ts_us", "lsn")).alias("v"), F.count("*").alias("n_versions"))


def deleted(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete; the old value stays."""
    return newest(log).where("tomb = 1").select("k", "v", "ts_us")


def live(log: DataFrame) -> DataFrame:
    return newest(log).where("tomb = 0").select("k", "v")


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with a delete of each key (k, ts_us, lsn) that has a version, which keeps its value."""
    marks = keys.join(newest(log).select("k", "v"), "k").withColumn("tomb", F.lit(1))
    return log.unionByName(marks)


def purge(log: DataFrame) -> DataFrame:
    """Keys without deleted ones, physically removed by an anti join."""
    now = newest(log)
    return now.join(now.where("tomb = 1").select("k"), "k", "left_anti").select("k", "v")


def get(log: DataFrame, key: str) -> DataFrame:
    return newest(log.where(F.col("k") == key))


def prefix(table: DataFrame, start: str) -> DataFrame:
    return table.where(F.startswith(F.col("k"), F.lit(start)))


def between(table: DataFrame, low: str, high: str) -> DataFrame:
    """low <= k <= high; a range that is empty or one key is refused."""
    if high.encode() <= low.encode():
        raise ValueError("the range's upper end must be above its lower end")
    return table.where(F.col("k").between(low, high))


def page(table: DataFrame, number: int, size: int) -> DataFrame:
    """The number-th page (from 1; smaller ones mean the first) of size keys in key order."""
    return table.orderBy("k").offset(max(number - 1, 0) * size).limit(size)

"""Seeded random input: the same rows for the same seed, on any number of executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters of keys and values, and their lengths.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY, VALUE = 5, 6


def _word(digest: Column, length: int) -> Column:
    """Letters by a digest's bytes."""
    place = lambda j: (F.conv(F.substring(digest, 2 * j + 1, 2), 16, 10).cast("int") % len(LETTERS)) + 1
    return F.concat(*(F.substr(F.lit(LETTERS), place(j), F.lit(1)) for j in range(length)))


def _digest(seed: int, what: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col("id").cast("string")).cast("binary"))


def random_puts(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """lsn (from 1), k, v of n puts."""
    return spark.range(n).select((F.col("id") + 1).alias("lsn"), _word(_digest(seed, "k"), KEY).alias("k"), _word(_digest(seed, "v"), VALUE).alias("v"))


def random_ints(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, value: n numbers of 32 bits."""
    return spark.range(n).select("id", F.conv(F.substring(_digest(seed, "i"), 1, 8), 16, 10).cast("long").alias("value"))

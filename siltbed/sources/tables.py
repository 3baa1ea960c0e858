"""The driver's tables mapped onto the key-value model.

A log has k (string), v, ts_us (microseconds), tomb (0 or 1) and lsn (1, 2, ...). Keys compare by
their UTF-8 bytes, which is Spark's default for strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: a key for each user, a delete for each error."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    tomb = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("k"), F.col("value").alias("v"), ts.alias("ts_us"), tomb.alias("tomb"), (F.col("event_id") + 1).alias("lsn"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as an insert-only table: the name's largest part key is its value."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("k")).agg(F.max("p_partkey").alias("v"))

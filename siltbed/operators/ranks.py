"""Positions in a total order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], name: str, buckets: int = 64) -> DataFrame:
    """df with `name`: each row's place, from 0, by the order columns, the first of which is dealt out.

    Rows fall into ranges of the first order column, between values of a sample that a hash of the row draws (the
    same one each time the plan runs); a range's rows are numbered in one task, after the counts of the ranges before it.
    """
    first = F.col(order[0])
    share = min(1.0, 64 * buckets / max(df.count(), 1))
    drawn = df.where(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < int(share * (1 << 30))).where(first.isNotNull())
    sample = sorted(r[0] for r in drawn.select(order[0]).collect())  # about 64 for each bucket
    bounds = sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}) if sample else []
    bucket = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < first)) if bounds else F.lit(0)
    keyed = df.withColumn("_bucket", F.when(first.isNull(), -1).otherwise(bucket))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # buckets + 1 rows
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return keyed.withColumn(name, place).join(F.broadcast(counts), "_bucket").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_bucket", "_before")


def running(df: DataFrame, order: list[str], value: str, name: str, buckets: int = 64) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before, by the order columns. Dealt out as in numbered()."""
    placed = numbered(df, order, "_place", buckets).withColumn("_block", F.floor(F.col("_place") / 4096))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_block").agg(F.sum(value).alias("_s")).withColumn("_sum", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")  # a row for 4096
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, inner).join(sums, "_block").withColumn(name, (F.col(name) + F.col("_sum")).cast("long")).drop("_block", "_sum", "_place")

"""Count-min and HyperLogLog sketches as tables that merge by sum and by maximum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1, high_word, seeded

#: Fixed value: bits of a HyperLogLog hash that choose the register.
PRECISION = 16


def cms_size(epsilon: Column, delta: Column) -> tuple[Column, Column]:
    """(m, k): columns and rows for an error of epsilon with a probability of delta."""
    return F.ceil(F.lit(math.e) / epsilon).cast("long"), F.ceil(F.log(F.lit(math.e) / delta)).cast("long")


def cms_cells(key: Column, m: int, k: int) -> Column:
    """(r, c): a key's cell in each row."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("r"), (high_word(seeded(key, i)) % m).cast("long").alias("c")))


def cms(rows: DataFrame, key: Column, m: int, k: int, group: list[str] | None = None) -> DataFrame:
    """r, c, n of the rows' sketch, one for each group. Keys are counted before they are hashed."""
    group = group or []
    counted = rows.groupBy(*group, key.alias("_key")).agg(F.count("*").alias("_n"))
    cells = counted.select(*group, "_n", F.explode(cms_cells(F.col("_key"), m, k)).alias("cell"))
    return cells.groupBy(*group, "cell.r", "cell.c").agg(F.sum("_n").alias("n"))


def cms_estimates(sketch: DataFrame, keys: DataFrame, m: int, k: int) -> DataFrame:
    """k, est: the smallest of each key's cells, at least its count."""
    cells = keys.select("k", F.explode(cms_cells(F.col("k"), m, k)).alias("cell")).select("k", "cell.r", "cell.c")
    return cells.join(F.broadcast(sketch), ["r", "c"], "left").groupBy("k").agg(F.min(F.coalesce("n", F.lit(0))).alias("est"))  # m * k rows are sent


def hll_registers(rows: DataFrame, key: Column, group: list[str] | None = None) -> DataFrame:
    """bucket, rank: the registers that are set. Distinct keys are hashed once."""
    group = group or []
    h = fnv1(F.col("_key"))
    hashed = rows.select(*group, key.alias("_key")).distinct().select(*group, h.alias("h"))
    rank = F.when(F.col("h") == 0, 33).otherwise(1 + F.log2(F.col("h").bitwiseAND(-F.col("h")).cast("double"))).cast("int")
    return hashed.select(*group, F.shiftright("h", 32 - PRECISION).alias("bucket"), rank.alias("rank")).groupBy(*group, "bucket").agg(F.max("rank").alias("rank"))


def hll_estimates(registers: DataFrame, group: list[str] | None = None) -> DataFrame:
    """est (4 decimals), n_nonempty of registers, with the small and large range corrections."""
    m, two32 = float(2**PRECISION), float(2**32)
    sums = registers.groupBy(*(group or [])).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("n_nonempty"))
    empty = F.lit(m) - F.col("n_nonempty")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("s") + empty)
    small = F.when(empty > 0, F.lit(m) * F.log(F.lit(m) / empty)).otherwise(raw)
    est = F.when(raw <= 2.5 * m, small).when(raw > two32 / 30, -F.lit(two32) * F.log(1 - raw / two32)).otherwise(raw)
    return sums.select(*(group or []), F.round(est, 4).alias("est"), "n_nonempty")


def approx_distinct(rows: DataFrame, column: str) -> DataFrame:
    """est, exact: an accurate estimate of distinct values (an extension; FNV-1 leaves the compatible sketch far off) and their count.

    Both are taken over the distinct values, so that a task has one sketch: beside count_distinct() each value would carry its own (13 KB).
    """
    values = rows.select(F.col(column).alias("_value")).distinct()
    return values.agg(F.approx_count_distinct("_value", 0.01).alias("est"), F.count("_value").alias("exact"))

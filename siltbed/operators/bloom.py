"""Bloom filters as sets of bit positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import low_bits, seeded


def bits(n: Column, p: float) -> Column:
    """Bits for n keys at a false positive rate of p."""
    return F.ceil(n * F.abs(F.log(F.lit(p))) / F.pow(F.log(F.lit(2.0)), F.lit(2.0))).cast("long")


def hashes(n: Column, m: Column) -> Column:
    return F.ceil(m / n * F.log(F.lit(2.0))).cast("long")


def params(counts: DataFrame, p: float) -> DataFrame:
    """counts (with n) and m, k."""
    return counts.withColumn("m", bits(F.col("n"), p)).withColumn("k", hashes(F.col("n"), F.col("m")))


def positions(key: Column, k: Column, m: Column) -> Column:
    """The k positions of a key among m bits."""
    return F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: low_bits(seeded(key, i)) % m)


def build(keys: DataFrame, group: list[str], spare: int, p: float) -> tuple[DataFrame, DataFrame]:
    """(pos by group, parameters by group) of the filters of distinct keys (column key), sized for n + spare."""
    one = keys.select(*group, F.col("key")).distinct()
    sized = params(one.groupBy(*group).agg((F.count("*") + spare).alias("n")), p)
    joined = one.join(sized, group) if group else one.join(F.broadcast(sized))  # without a group, one row
    found = joined.select(*group, F.explode(positions(F.col("key"), F.col("k"), F.col("m"))).alias("pos")).distinct()
    return found, sized


def packed(filter_: DataFrame, group: list[str]) -> DataFrame:
    """word, bits by group: the set positions as words of 32 bits, as a filter is stored."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 32).cast("int"))
    return filter_.groupBy(*group, F.floor(F.col("pos") / 32).alias("word")).agg(F.bit_or(bit).alias("bits"))


def unpacked(words: DataFrame, group: list[str]) -> DataFrame:
    """The set positions (pos by group) of a stored filter."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(1) == 1)
    return words.select(*group, F.explode(bits).alias("bit"), "word").select(*group, (32 * F.col("word") + F.col("bit")).alias("pos"))


def probe_by(filter_: DataFrame, sized: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    """maybe of each (group, key): 1 if all of a key's positions are set in its group's filter."""
    wanted = keys.join(sized, group).select(*group, "key", F.explode(F.array_distinct(positions(F.col("key"), F.col("k"), F.col("m")))).alias("pos"))
    hit = wanted.join(filter_.withColumn("hit", F.lit(1)), [*group, "pos"], "left")
    return hit.groupBy(*group, "key").agg(F.min(F.coalesce("hit", F.lit(0))).alias("maybe"))


def probe(filter_: DataFrame, sized: DataFrame, keys: DataFrame) -> DataFrame:
    """key, maybe: 1 if all of a key's positions are set. No key that was added gets 0."""
    wanted = keys.join(F.broadcast(sized)).select("key", F.explode(F.array_distinct(positions(F.col("key"), F.col("k"), F.col("m")))).alias("pos"))
    hit = wanted.join(filter_.withColumn("hit", F.lit(1)), "pos", "left")
    return hit.groupBy("key").agg(F.min(F.coalesce("hit", F.lit(0))).alias("maybe"))

"""Merging runs and levels: newer versions first, deletes dropped only at the deepest level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """k, v, ts_us, tomb, src of two runs merged; the larger ts_us wins, a tie the new run (src 2)."""
    both = old.withColumn("src", F.lit(1)).unionByName(new.withColumn("src", F.lit(2)))
    best = F.max_by(F.struct("v", "ts_us", "tomb", "src"), F.struct("ts_us", "src", "lsn")).alias("s")
    return both.groupBy("k").agg(best).select("k", "s.v", "s.ts_us", "s.tomb", "s.src")


def without_deletes(merged: DataFrame) -> DataFrame:
    """What the deepest level keeps. Dropping deletes before the merge would bring older versions back."""
    return merged.where("tomb = 0").select("k", "v")


def split_runs(log: DataFrame, runs: int) -> DataFrame:
    """The log with `level`: equal ranges of lsn, the newest at level 1."""
    top = log.agg(F.max("lsn").alias("top"))
    level = runs - F.least(F.lit(runs - 1), F.floor((F.col("lsn") - 1) * runs / F.col("top")))
    return log.join(F.broadcast(top)).withColumn("level", level.cast("int")).drop("top")


def lookup_level(leveled: DataFrame) -> DataFrame:
    """k, level: the shallowest level that has each key."""
    return leveled.groupBy("k").agg(F.min("level").alias("level"))


def merged_levels(leveled: DataFrame) -> DataFrame:
    """k, v, level: each key's newest version in the shallowest level that has it."""
    best = F.min_by(F.struct("v", "level"), F.struct("level", -F.col("ts_us"), -F.col("lsn"))).alias("s")
    return leveled.groupBy("k").agg(best).select("k", "s.v", "s.level")


def plan_levels(flushes: int, threshold: int, depth: int) -> list[tuple[int, int, int]]:
    """(flush, level, n): the size of each level that is in use after each flush of `threshold` distinct keys.

    A run goes to level 1. A level in use merges with it: a result of threshold * 2^level keys or
    more goes on to the next level, a smaller one stays. The deepest level merges in place.
    This is planning over run sizes, a number for each level; it reads no rows.
    """
    levels = [0] * (depth + 1)
    out = []
    for flush in range(1, flushes + 1):
        run, at = threshold, 1
        while True:
            if not levels[at]:
                levels[at] = run
                break
            run += levels[at]
            if at == depth or run < threshold * 2**at:
                levels[at] = run
                break
            levels[at] = 0
            at += 1
        out += [(flush, level, n) for level, n in enumerate(levels) if n]
    return out


def next_generation(manifest: DataFrame) -> DataFrame:
    """next_gen from (level, generation): one more than the shallowest run's, 0 without runs. Empty levels have -1."""
    return manifest.where("generation >= 0").agg(F.coalesce(F.min_by("generation", "level") + 1, F.lit(0)).alias("next_gen"))

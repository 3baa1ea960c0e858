"""Merkle digests of ordered records by group.

Leaves are SHA-1 hashes of record texts, padded to 2^max(2, ceil(log2 n)) by 20 zero bytes; a
parent is the SHA-1 of its children's 40 bytes. Subtrees of 2^STEP leaves are folded in one row each,
and their roots again, so no row holds more than 2^STEP hashes of a group of any size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 10


def record_text(ts: Column, tomb: Column, key: Column, value: Column) -> Column:
    """The text that is hashed: byte lists are decimal, in square brackets."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda i: F.conv(F.substr(F.hex(c.cast("binary")), 2 * i + 1, F.lit(2)), 16, 10)), " "), F.lit("]"))
    return F.concat(F.lit("{CRC:0 timestamp:"), ts.cast("string"), F.lit(" tombstone:"), tomb.cast("string"), F.lit(" KeySize:0 ValueSize:0 key:"), listed(key), F.lit(" value:"), listed(value), F.lit("}"))


def leaves(rows: DataFrame, group: str, order: str, text: Column) -> DataFrame:
    """g, idx, hash (bytes), in the order of the key."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.select(F.col(group).alias("g"), at.cast("long").alias("idx"), F.unhex(F.sha1(text.cast("binary"))).alias("hash"))


def _pair(nodes: Column) -> Column:
    """The level above an even number of nodes."""
    return F.transform(F.sequence(F.lit(0), (F.size(nodes) / 2).cast("int") - 1), lambda i: F.unhex(F.sha1(F.concat(F.element_at(nodes, 2 * i + 1), F.element_at(nodes, 2 * i + 2)))))


def _zero(level: int) -> bytes:
    """The node over 2^level padded leaves."""
    out = bytes(20)
    for _ in range(level):
        out = hashlib.sha1(out + out).digest()  # noqa: S324
    return out


def _depths(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("g").agg((F.max("idx") + 1).alias("n")).withColumn("depth", F.greatest(F.lit(2), F.ceil(F.log2(F.col("n").cast("double")))).cast("int"))


def roots(nodes: DataFrame, step: int = STEP) -> DataFrame:
    """g, n, root (lowercase hex) from leaves()."""
    sizes = _depths(nodes)
    deepest = sizes.agg(F.max("depth")).first()[0] or 0  # one number
    now, level = nodes, 0
    while level < deepest:
        up = F.least(F.lit(step), F.greatest(F.col("depth") - level, F.lit(0)))
        blocks = now.join(sizes.select("g", "depth"), "g").withColumn("up", up).withColumn("block", F.shiftright("idx", step))
        held = blocks.groupBy("g", "block", "up").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("a"))
        pad = F.array_repeat(F.lit(_zero(level)), (F.pow(F.lit(2), "up") - F.size("a")).cast("int"))
        full = F.concat(F.transform("a", lambda x: x["hash"]), pad)
        folded = F.aggregate(F.sequence(F.lit(0), F.col("up")), full, lambda x, i: F.when(i == 0, x).otherwise(_pair(x)))
        now = held.select("g", F.col("block").alias("idx"), F.element_at(folded, 1).alias("hash"))
        level += step
    return now.join(sizes, "g").select("g", "n", F.lower(F.hex("hash")).alias("root"))


def levels(nodes: DataFrame, folder: str) -> DataFrame:
    """g, level (0: leaves), idx, hash of the whole tree of each group. A level is written to `folder` and the next one made of it."""
    sizes = _depths(nodes).select("g", "depth")
    spark, deepest = nodes.sparkSession, sizes.agg(F.max("depth")).first()[0] or 0
    now, out = nodes.select("g", "idx", "hash"), None
    for level in range(deepest + 1):
        if level:
            up = now.join(F.broadcast(sizes) if deepest <= 20 and sizes.count() <= 1 << 16 else sizes, "g").where(F.col("depth") >= level)
            pairs = up.groupBy("g", F.shiftright("idx", 1).alias("up")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))).alias("left"), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))).alias("right"))
            pad = F.lit(_zero(level - 1))
            now = pairs.select("g", F.col("up").alias("idx"), F.unhex(F.sha1(F.concat(F.coalesce("left", pad), F.coalesce("right", pad)))).alias("hash"))
        now.write.mode("overwrite").parquet(f"{folder}/{level}")
        now = spark.read.schema(now.schema).parquet(f"{folder}/{level}")
        own = now.select("g", F.lit(level).alias("level"), "idx", F.lower(F.hex("hash")).alias("hash"))
        out = own if out is None else out.union(own)
    return out


def same_roots(before: DataFrame, after: DataFrame) -> DataFrame:
    """g, same: 1 where two tables of roots agree."""
    other = after.select("g", F.col("root").alias("other"))
    return before.join(other, "g", "full").select("g", F.when(F.col("root").eqNullSafe(F.col("other")), 1).otherwise(0).alias("same"))

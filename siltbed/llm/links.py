"""Connected components of a table of links, by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Links of a file of a round: rounds of few links leave few files.
FILE = 1 << 18


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): for each node of edges (a, b), the smallest node it can reach.

    Alternates large-star and small-star rounds: each node hands its larger, then its smaller
    neighbours to the smallest one, until nothing changes; the rounds grow as the logarithm of the
    longest path. A node with many neighbours is only ever aggregated with map-side minima. Rows
    with a null end are ignored, and so are loops and repeated links.
    """
    now = scratch.save(_stars(edges.where("a is not null and b is not null and a != b")), f"{name}0")
    k, seen = 0, _sum(now)
    while True:
        k += 1
        files = seen[0] // FILE + 1
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        low = low.select((F.col("a") + F.lit(0)).alias("a"), "least")  # dealt out anew, so that rows of a hub can be split
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = scratch.save(_stars(large).coalesce(files), f"{name}{k}l")  # a > b from here on
        floor = large.groupBy("a").agg(F.min("b").alias("least")).select((F.col("a") + F.lit(0)).alias("a"), "least")
        small = large.join(floor, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct(F.col("a").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        new = scratch.save(_stars(small).coalesce(files), f"{name}{k}")
        scratch.drop(f"{name}{k}l", f"{name}{k - 1}")
        now, before, seen = new, seen, _sum(new)
        if seen == before:
            break
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _sum(edges: DataFrame) -> tuple:
    """A count and a sum of hashes, which tell whether a round has changed the links."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]

"""Mixing sources to target weights: whole copies, then a Pareto order sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .scratch import Scratch

#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
#: Sources up to which tables of a row for each are sent to all executors; more are joined by hash and numbered in ranges.
SENT = 1 << 16


def targets(sources: DataFrame, scratch: Scratch, weights: list[float], share: float, most: float) -> DataFrame:
    """(key, source_size, target) of each source, from (key, source_size).

    Sources in the order of their keys weigh `weights`, repeating. Targets share `share` of all
    words by weight; none is above `most` times its source's words, the excess is shared again by weight.
    """
    if sources.count() <= SENT:
        sources = sources.withColumn("place", F.row_number().over(Window.orderBy("key")) - 1)
    else:
        sources = numbered(sources, ["key"], "place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    table = scratch.save(sources.withColumn("weight", weight).drop("place"), "weights")
    cap, level, capped = F.col("source_size") * float(most), None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        row = table.agg(F.sum("source_size").alias("words"), F.sum(F.when(full, cap).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == capped or not row["free"]:
            break
        level, capped = ((row["words"] or 0) * share - row["held"]) / row["free"], row["n"]
    level = level or 0.0
    return table.select("key", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def mix(docs: DataFrame, scratch: Scratch, *, weights: list[float] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 1, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each document.

    A document's expected copies are its source's target over its source's words, times its weight over
    the source's mean if `weight` is given, `most` at most. The whole part is certain. The rest is
    sampled by Pareto order: documents of a source are ranked by u / (1 - u) over p / (1 - p), with u
    from a hash of doc_id and p the fraction left, and the first ones are taken until their words
    come to what the target still lacks; the last place goes to the document whose size fits best.

    The cut in a source's order is found by two histograms of BUCKETS bins, so no source, however
    large, is sorted in one task. Null texts and texts without words have size 0 and are never taken.
    A null source is a source of its own, the last. Rows with equal ids share u; further ties go by
    size, then row. An empty table gives no rows. Columns other than doc_id, text, source are not read.
    """
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    read = docs.select("doc_id", "source", key.alias("key"), size.alias("size"), ((hashed + 0.5) / 2.0**52).alias("u"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(read, "rows")
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.try_divide(F.sum(F.col("w") * F.col("size")), F.sum("size")).alias("mean"))
    sources = scratch.save(sources, "sources")
    few = sources.count() <= SENT
    sent = lambda by_source: F.broadcast(by_source) if few else by_source
    goals = scratch.save(targets(sources.drop("mean"), scratch, list(weights), share, float(most)).join(sources.select("key", "mean"), "key"), "goals")
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.try_divide(F.col("target"), F.col("source_size")) * (F.lit(1.0) if weight is None else F.try_divide(F.col("w"), F.col("mean"))))).otherwise(0.0)
    rows = rows.join(sent(goals.drop("mean")), "key").withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("whole")
    odds = F.try_divide(F.col("u") / (1 - F.col("u")), p / (1 - p))
    rows = rows.withColumn("q", F.when((p > 0) & (F.col("size") > 0), odds)).withColumn("x", F.col("q") / (1 + F.col("q")) * BUCKETS)
    rows = rows.withColumn("b", F.floor("x").cast("int")).withColumn("c", F.floor((F.col("x") - F.floor("x")) * BUCKETS).cast("int"))
    lacking = rows.groupBy("key").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("lack"))
    lacking = scratch.save(lacking, "lacking")
    # The bin of each source in which its words pass what it lacks, and then that bin's own bin.
    first = _cut(rows.where("q is not null"), lacking, "b")
    first = scratch.save(first, "first")
    inner = rows.where("q is not null").join(sent(first.select("key", "b", "left")), ["key", "b"])
    second = scratch.save(_cut(inner, first.select("key", F.col("left").alias("lack")), "c"), "second")
    edge = inner.drop("left").join(sent(second.withColumnRenamed("left", "rest")), ["key", "c"])
    run = F.sum("size").over(Window.partitionBy("key").orderBy("q", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    edge = scratch.save(edge.withColumn("run", run).where("run <= rest").select("key", "row", "size"), "edge")
    cuts = first.select("key", F.col("b").alias("b0")).join(second.select("key", F.col("c").alias("c0")), "key", "left")
    marked = rows.join(sent(cuts), "key", "left").join(edge.select("key", "row", F.lit(1).alias("in_edge")), ["key", "row"], "left")
    # A source without a cut lacks more than it can give: all its documents come.
    chosen = F.col("q").isNotNull() & (F.col("b0").isNull() | (F.col("b") < F.col("b0")) | ((F.col("b") == F.col("b0")) & (F.col("c") < F.col("c0"))) | F.col("in_edge").isNotNull())
    marked = marked.withColumn("one", F.when(chosen, 1).otherwise(0))
    marked = scratch.save(marked.select("doc_id", "source", "key", "row", "size", "source_size", "target", "whole", "q", "one"), "marked")
    short = marked.groupBy("key").agg((F.max("target") - F.sum(F.col("size") * (F.col("whole") + F.col("one")))).alias("short"))
    spare = marked.where("q is not null and one = 0").join(sent(short), "key").withColumn("off", F.abs(F.col("short") - F.col("size"))).where("off < abs(short)")
    last = spare.groupBy("key").agg(F.min(F.struct("off", "q", "doc_id", "row")).alias("best")).select("key", F.col("best.row").alias("row"), F.lit(1).alias("last"))
    copies = F.col("whole") + F.col("one") + F.coalesce("last", F.lit(0))
    out = marked.join(sent(last), ["key", "row"], "left").withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _cut(rows: DataFrame, lacking: DataFrame, bin_: str) -> DataFrame:
    """(key, bin, left): the bin of each key in which its running words pass `lack`, and what is left before it."""
    sums = rows.groupBy("key", bin_).agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("key").orderBy(bin_))  # at most BUCKETS rows for each key
    sums = sums.withColumn("run", run).join(lacking, "key").where("run > lack")
    best = sums.groupBy("key").agg(F.min(F.struct(bin_, (F.col("lack") - F.col("run") + F.col("words")).alias("left"))).alias("m"))
    return best.select("key", f"m.{bin_}", "m.left")

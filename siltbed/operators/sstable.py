"""Sorted runs: record layout, dense index, sparse summary, zone map, and reads pruned by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memtable import SHARD
from .ranks import numbered, running

#: Bytes of a record's and an index entry's fixed part, and of a single-file header.
RECORD, ENTRY, HEADER = 29, 16, 48


def layout(rows: DataFrame) -> DataFrame:
    """k, crc, record_size, offset of (k, v) rows written in key order after the header."""
    sized = rows.select("k", F.crc32(F.col("k").cast("binary")).alias("crc"), (F.octet_length("k") + F.octet_length("v") + RECORD).cast("long").alias("record_size"))
    return running(sized, ["k"], "record_size", "offset").withColumn("offset", F.col("offset") + HEADER)


def verify(records: DataFrame) -> DataFrame:
    """k, ok: whether each record's checksum is that of its key."""
    return records.select("k", F.when(F.crc32(F.col("k").cast("binary")) == F.col("crc"), 1).otherwise(0).alias("ok"))


def dense_index(records: DataFrame) -> DataFrame:
    """k, offset, index_offset: an entry for each record."""
    sized = records.select("k", "offset", (F.octet_length("k") + ENTRY).cast("long").alias("_size"))
    return running(sized, ["k"], "_size", "index_offset").select("k", "offset", "index_offset")


def summary(index: DataFrame, every: int) -> DataFrame:
    """seg, k, index_offset: each every-th index entry."""
    return numbered(index, ["k"], "_at").where(F.col("_at") % every == 0).select(F.floor(F.col("_at") / every).alias("seg"), "k", "index_offset")


def zone_map(rows: DataFrame) -> DataFrame:
    """generation, first_k, last_k, n of each run."""
    return rows.groupBy("generation").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count("*").alias("n"))


def floor_entry(summary: DataFrame, probes: list[str]) -> DataFrame:
    """probe, seg: the last summary entry at or before each probe. Probes are literals, so the summary is read once."""
    spark = summary.sparkSession
    asked = F.broadcast(spark.createDataFrame([(p,) for p in probes], "probe string"))
    return summary.join(asked, F.col("k") <= F.col("probe")).groupBy("probe").agg(F.max_by("seg", "k").alias("seg"))


def pruned_lookup(rows: DataFrame, bloom: DataFrame, probes: list[str], params: DataFrame) -> DataFrame:
    """probe, generation, zone_ok, bloom_ok, found for each probe and run.

    bloom has (generation, pos), params (generation, m, k). The pairs of a probe and a run that zone and filter let pass
    are found first, and only they are joined to the rows: where these are stored by generation (memtable.write_runs), no folder without
    such a run is read, and within one the probes are pushed down to its row groups. found is 1 where the run has the key.
    """
    from .bloom import positions

    spark = rows.sparkSession
    asked = spark.createDataFrame([(p,) for p in probes], "probe string")
    zones = zone_map(rows).join(params, "generation").join(F.broadcast(asked))  # probes are a handful of literals
    zones = zones.withColumn("zone_ok", F.when(F.col("probe").between(F.col("first_k"), F.col("last_k")), 1).otherwise(0))
    bits = zones.select("probe", "generation", "k", F.explode(positions(F.col("probe"), F.col("k"), F.col("m"))).alias("pos")).distinct()
    need = bits.groupBy("probe", "generation").agg(F.count("*").alias("need"))
    have = bits.join(bloom, ["generation", "pos"]).groupBy("probe", "generation").agg(F.count("*").alias("have"))
    tested = zones.select("probe", "generation", "zone_ok").join(need, ["probe", "generation"]).join(have, ["probe", "generation"], "left")
    tested = tested.withColumn("bloom_ok", F.when(F.col("need") == F.col("have"), 1).otherwise(0))
    open_ = tested.where("zone_ok = 1 and bloom_ok = 1").select("probe", "generation")  # few: probes, and false positives
    on = ["probe", "generation"]
    if "shard" in rows.columns:
        open_, on = open_.withColumn("shard", F.floor(F.col("generation") / SHARD).cast("long")), [*on, "shard"]
    hits = rows.where(F.col("k").isin(probes)).withColumnRenamed("k", "probe").join(F.broadcast(open_), on)
    hits = hits.select("probe", "generation", F.lit(1).alias("hit")).distinct()
    out = tested.join(hits, ["probe", "generation"], "left")
    return out.select("probe", "generation", "zone_ok", "bloom_ok", F.coalesce("hit", F.lit(0)).alias("found"))


def index_probe(index: DataFrame, summary: DataFrame, probes: list[str], every: int) -> DataFrame:
    """probe, seg, offset: the segment of the index that may hold each probe, and its record's place, -1 where there is none.

    Only the entries of the probes' segments take part in the search."""
    asked = floor_entry(summary, probes)
    placed = numbered(index, ["k"], "_at").select(F.floor(F.col("_at") / every).alias("seg"), "k", "offset")
    segments = F.broadcast(asked.select("seg", "probe"))  # a row for each probe
    found = placed.join(segments, "seg").where(F.col("k") == F.col("probe")).select("probe", "offset")
    return asked.join(F.broadcast(found), "probe", "left").select("probe", "seg", F.coalesce("offset", F.lit(-1)).alias("offset"))


def contents(runs: DataFrame, params: DataFrame, every: int) -> DataFrame:
    """generation, n, then where each section of the run's single file begins and the file ends: records, index, summary, filter.

    runs has (generation, k); values are 8 bytes, params (generation, m) has the filters' bits. A run has no more rows
    than a memtable, so they are numbered by run."""
    key = F.octet_length("k")
    place = F.row_number().over(Window.partitionBy("generation").orderBy("k")) - 1
    sizes = runs.select("generation", key.alias("size"), (place % every == 0).alias("sampled")).groupBy("generation").agg(
        F.count("*").alias("n"), F.sum(F.col("size") + RECORD + 8).alias("records"), F.sum(F.col("size") + ENTRY).alias("entries"), F.sum(F.when(F.col("sampled"), F.col("size") + ENTRY).otherwise(0)).alias("summary")
    )
    at = F.lit(HEADER).cast("long")
    out = [F.col("generation"), F.col("n"), at.alias("records_at")]
    for name, size in (("index_at", F.col("records")), ("summary_at", F.col("entries")), ("filter_at", F.col("summary")), ("end_at", F.ceil(F.col("m") / 8).cast("long"))):
        at = at + size
        out.append(at.alias(name))
    return sizes.join(params.select("generation", "m"), "generation").select(*out)

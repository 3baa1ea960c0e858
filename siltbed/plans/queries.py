"""Registered queries over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bloom, cache, compaction, kv, limiter, memtable, merkle, simhash, sketches, sstable, wal
from ..sources import generator
from ..sources.folders import own_folder
from ..sources.sketches import SketchStore
from ..sources.store import Options, Store
from ..sources.tables import event_log, part_names, read

CMS_M, CMS_K = 28, 2
DAY = 86_400_000_000
#: Probe keys of the index queries.
CUSTOMERS = ["Customer#000000001", "Customer#000000042", "Customer#0000001", "Customer#000000100", "Customer#000000149", "Customer#9", "Customer#", "A", "Customer#000000077", "Customer#000000003"]
ORDERS = ["1", "10", "100", "1000", "42", "777", "5", "99999", "-1", "abc"]
MANIFEST = [(1, -1), (2, 7), (3, 4), (4, 2)]
SIZES = [(0.1, 0.9), (0.01, 0.1), (0.001, 0.01), (0.05, 0.5)]
FLUSHES, THRESHOLD, DEPTH = 15, 5, 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Reads and writes


@query
def kv_put_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.newest(event_log(spark, sf_dir))


@query
def kv_upsert_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.upsert(event_log(spark, sf_dir))


@query
def kv_delete_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.deleted(event_log(spark, sf_dir))


@query
def kv_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.live(event_log(spark, sf_dir))


@query
def kv_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.purge(event_log(spark, sf_dir))


@query
def kv_get_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get(event_log(spark, sf_dir), "7")


@query
def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.prefix(part_names(spark, sf_dir), "blu")


@query
def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.between(part_names(spark, sf_dir), "blue", "red")


@query
def kv_scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.page(part_names(spark, sf_dir), 2, 5)


# The memtable


@query
def memtable_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memtable.sizes(event_log(spark, sf_dir), 100)


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memtable.generations(read(spark, sf_dir, "orders").select("o_orderkey").distinct(), "o_orderkey", 500)


@query
def memtable_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generations(spark, sf_dir).groupBy("generation").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("min_k"), F.max("o_orderkey").alias("max_k"))


@query
def memtable_sorted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memtable.sorted_runs(_generations(spark, sf_dir), "o_orderkey")


@query
def memtable_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store for each event type; users are put again and again."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("store"), F.col("user_id").cast("string").alias("k"), (F.col("event_id") + 1).alias("lsn"))
    return memtable.flushes(events, 20)


# Sorted runs


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.layout(read(spark, sf_dir, "customer").select(F.col("c_name").alias("k"), F.col("c_mktsegment").alias("v")))


@query
def sst_record_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


@query
def sst_crc_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fifth key, by its checksum, was damaged after it was written."""
    damaged = F.when(F.col("crc") % 5 == 0, F.concat("k", F.lit("x"))).otherwise(F.col("k"))
    return sstable.verify(_records(spark, sf_dir).withColumn("k", damaged))


@query
def sst_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.dense_index(_records(spark, sf_dir))


@query
def sst_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.summary(sst_index(spark, sf_dir), 3)


@query
def sst_index_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = sst_index(spark, sf_dir)
    return sstable.index_probe(index, sstable.summary(index, 3), CUSTOMERS, 3)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generations(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("k"), "generation")


@query
def sst_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.zone_map(_runs(spark, sf_dir))


@query
def sst_summary_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.floor_entry(sst_summary(spark, sf_dir), CUSTOMERS)


@query
def sst_lookup_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs are written, and read from there."""
    folder = own_folder(spark, "runs")
    memtable.write_runs(_runs(spark, sf_dir), folder)
    runs = spark.read.schema("k string, generation long, shard long").parquet(folder)
    filters, sized = bloom.build(runs.drop("shard").withColumnRenamed("k", "key"), ["generation"], 50, 0.1)
    return sstable.pruned_lookup(runs, filters, ORDERS, sized.select("generation", "m", "k"))


@query
def sst_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    sized = bloom.params(runs.groupBy("generation").agg((F.count("*") + 50).alias("n")), 0.1)
    return sstable.contents(runs, sized, 3)


# Compaction and levels


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = compaction.split_runs(event_log(spark, sf_dir), 2)
    return compaction.merge(log.where("level = 2").drop("level"), log.where("level = 1").drop("level"))


@query
def compaction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query
def compaction_drop_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.without_deletes(_merged(spark, sf_dir))


@query
def lsm_level_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(compaction.plan_levels(FLUSHES, THRESHOLD, DEPTH), "flush int, level int, n int")


@query
def lsm_next_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.next_generation(spark.createDataFrame(MANIFEST, "level int, generation int"))


@query
def lsm_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of events are put and flushed; the second flush merges the first one's run, and both go down a level."""
    store = Store(spark, own_folder(spark, "store"), Options(threshold=5, depth=4))
    log = event_log(spark, sf_dir)
    for i in range(3):
        store.put(log.where(F.col("lsn") % 3 == i))
        store.flush()
    levels = sorted((int(level), g, store._run(g).count()) for level, g in store.manifest()["levels"].items())
    return spark.createDataFrame(levels, "level int, generation int, n long")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.split_runs(event_log(spark, sf_dir), 4)


@query
def lsm_lookup_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.lookup_level(_levels(spark, sf_dir))


@query
def lsm_prefix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.merged_levels(kv.prefix(_levels(spark, sf_dir), "1"))


@query
def lsm_range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.merged_levels(kv.between(_levels(spark, sf_dir), "10", "19"))


# Bloom filters and Merkle digests


@query
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return bloom.params(counts, 0.1)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"))


@query
def bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.build(_users(spark, sf_dir), [], 50, 0.1)[0]


@query
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    filter_, sized = bloom.build(_users(spark, sf_dir), [], 50, 0.1)
    asked = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    return bloom.probe(filter_, sized, asked).select(F.col("key").cast("long").alias("id"), "maybe")


@query
def bloom_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter for each event type is stored as words, opened again and asked for twice its users' numbers."""
    users = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("key"))
    filters, sized = bloom.build(users, ["name"], 50, 0.1)
    store = SketchStore(spark, own_folder(spark, "bloom"))
    store.add("bloom", bloom.packed(filters, ["name"]))
    asked = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (2 * F.col("user_id")).cast("string").alias("key")).distinct()
    found = bloom.probe_by(bloom.unpacked(store.bloom(), ["name"]), sized, asked, ["name"])
    return found.select("name", F.col("key").cast("long").alias("id"), "maybe")


def _leaves(spark: SparkSession, sf_dir: str, where: str = "true", value=None) -> DataFrame:  # noqa: ANN001
    rows = read(spark, sf_dir, "customer").where(where)
    value = F.col("c_mktsegment") if value is None else value
    return merkle.leaves(rows, "c_nationkey", "c_custkey", merkle.record_text(F.col("c_custkey"), F.lit(0), F.col("c_name"), value))


@query
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.roots(_leaves(spark, sf_dir))


@query
def merkle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.levels(_leaves(spark, sf_dir), own_folder(spark, "merkle"))


@query
def merkle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer's value changes, in one nation."""
    changed = F.when(F.col("c_custkey") == 1, F.lit("CHANGED")).otherwise(F.col("c_mktsegment"))
    return merkle.same_roots(merkle.roots(_leaves(spark, sf_dir)), merkle.roots(_leaves(spark, sf_dir, value=changed)))


# Log, cache, limiter


@query
def wal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.segments(event_log(spark, sf_dir), 10)


@query
def wal_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.dump(event_log(spark, sf_dir), 10)


@query
def wal_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.checksums(event_log(spark, sf_dir))


@query
def wal_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seventh record's value was damaged after it was written."""
    stored = wal.encode(event_log(spark, sf_dir))
    return wal.verify(stored.withColumn("v", F.when(F.col("lsn") % 7 == 0, F.col("v") + 1).otherwise(F.col("v"))))


@query
def wal_current_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.current_segment(event_log(spark, sf_dir), 10)


@query
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.replay(event_log(spark, sf_dir), 10, 50)


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("user_id").cast("string").alias("k"))


@query
def lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hits(_trace(spark, sf_dir), 16).withColumnRenamed("at", "event_id")


@query
def lru_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.final_state(_trace(spark, sf_dir), 16)


@query
def token_bucket_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test events lie minutes apart, so the window is a day."""
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return limiter.admit(log, 3, DAY, 5_000_000).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "ok")


# Sketches


@query
def cms_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = sketches.cms_size(F.col("eps"), F.col("delta"))
    return spark.createDataFrame(SIZES, "eps double, delta double").select("eps", "delta", m.alias("m"), k.alias("k"))


@query
def cms_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.cms(read(spark, sf_dir, "events"), F.col("event_type"), CMS_M, CMS_K)


@query
def cms_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("k"))
    exact = events.groupBy("k").agg(F.count("*").alias("exact"))
    found = sketches.cms_estimates(sketches.cms(events, F.col("k"), CMS_M, CMS_K), exact, CMS_M, CMS_K)
    return found.join(exact, "k")


@query
def cms_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch for each name; 16 bytes of a name count."""
    events = read(spark, sf_dir, "events").select(F.substring("event_type", 1, 16).alias("name"), F.col("user_id").cast("string").alias("k"))
    return sketches.cms(events, F.col("k"), CMS_M, CMS_K, ["name"])


@query
def cms_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches of two halves of the log are stored, opened again and merged."""
    events = read(spark, sf_dir, "events").select(F.substring("event_type", 1, 16).alias("name"), F.col("user_id").cast("string").alias("k"), "event_id")
    store = SketchStore(spark, own_folder(spark, "cms"))
    for half in (0, 1):
        store.add("cms", sketches.cms(events.where(F.col("event_id") % 2 == half), F.col("k"), CMS_M, CMS_K, ["name"]))
    return store.cms()


@query
def hll_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registers of two halves of the orders are stored, opened again and merged."""
    orders = read(spark, sf_dir, "orders").withColumn("name", F.substring("o_orderpriority", 1, 16))
    store = SketchStore(spark, own_folder(spark, "hll"))
    for half in (0, 1):
        store.add("hll", sketches.hll_registers(orders.where(F.col("o_orderkey") % 2 == half), F.col("o_custkey").cast("string"), ["name"]))
    return sketches.hll_estimates(store.hll(), ["name"]).select("name", "est")


@query
def hll_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.hll_registers(read(spark, sf_dir, "orders"), F.col("o_custkey").cast("string"))


@query
def hll_estimate_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.hll_estimates(hll_registers(spark, sf_dir))


@query
def hll_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("name", F.substring("o_orderpriority", 1, 16))
    return sketches.hll_estimates(sketches.hll_registers(orders, F.col("o_custkey").cast("string"), ["name"]), ["name"]).select("name", "est")


@query
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimate is within 5 % of the exact count."""
    found = sketches.approx_distinct(read(spark, sf_dir, "orders"), "o_custkey")
    return found.select("exact", (F.abs(F.col("est") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within"))


# Generated input


@query
def random_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.random_puts(spark, 1000, 42)


@query
def random_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.random_ints(spark, 1000, 42)


# Text


@query
def simhash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.tokens(read(spark, sf_dir, "documents"))


@query
def simhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint(read(spark, sf_dir, "documents"))


@query
def simhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.next_distance(simhash_fingerprint(spark, sf_dir))

"""The persistent store and the streams."""

from pyspark.sql import functions as F

from siltbed.operators import limiter
from siltbed.sources.store import Options, Store
from siltbed.streaming import live


def rows(spark, pairs, ts):
    return spark.createDataFrame([(k, v, ts) for k, v in pairs], "k string, v string, ts_us long")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Options(threshold=2, depth=3))
    assert store.flush() is None and store.live().count() == 0
    want = {}
    for i in range(12):
        own = {f"k{(i * 5 + j) % 17}": f"v{i}" for j in range(3)}
        want |= own
        store.put(rows(spark, own.items(), 10 * i))
        if i % 4 == 3:
            gone = f"k{i}"
            store.delete(spark.createDataFrame([(gone, 10 * i + 5), ("none", 10 * i + 5)], "k string, ts_us long"))
            want.pop(gone, None)
        if i % 2:
            store.flush()
        assert {r["k"]: r["v"] for r in store.live().collect()} == want
    assert {r["k"] for r in store.prefix("k1").where("tomb = 0").collect()} == {k for k in want if k.startswith("k1")}
    assert {r["k"] for r in store.between("k2", "k5").where("tomb = 0").collect()} == {k for k in want if "k2" <= k <= "k5"}
    assert [r["k"] for r in store.page(1, 4).collect()] == sorted(want)[:4]
    assert store.get("none").count() == 0


def test_limiter_stream_is_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("timestamp").alias("ts"))
    events.orderBy("at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    day = 86_400_000_000
    q = live.admit_stream(stream, 3, day, 5_000_000).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("admitted").collect())) == sorted(map(tuple, limiter.admit(events, 3, day, 5_000_000).collect()))


def test_ingest(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    data = spark.createDataFrame([(f"k{i % 7}", str(i), i, int(i % 5 == 0)) for i in range(50)], "k string, v string, ts_us long, tomb int")
    data.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = live.ingest(stream, store, f"{tmp_path}/c", flush_every=2)
    q.processAllAvailable()
    q.stop()
    newest = {}
    for r in data.collect():
        newest[r["k"]] = max(newest.get(r["k"], (-1, "", 0)), (r["ts_us"], r["v"], r["tomb"]))
    assert {r["k"]: (r["ts_us"], r["v"], r["tomb"]) for r in store.newest().collect()} == newest

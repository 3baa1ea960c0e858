"""Known answers, invariants and edge cases of the operators."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siltbed.functions.hashing import fnv1
from siltbed.operators import bloom, cache, compaction, kv, limiter, memtable, merkle, ranks, simhash, sketches, sstable, wal

PUTS = "data1 b h g data3 data9 c k data4 i data54 data75 data79 data80 dat1 data1 dat222".split()


@pytest.fixture(scope="module")
def log(spark):
    rows = [(k, f"val{i}", i * 10, 0, i + 1) for i, k in enumerate(PUTS)]
    return spark.createDataFrame(rows, "k string, v string, ts_us long, tomb int, lsn long")


def keys(df):
    return sorted(r["k"] for r in df.collect())


def test_reads_of_the_fixed_puts(log):
    state = kv.newest(log)
    assert keys(kv.prefix(state, "data")) == "data1 data3 data4 data54 data75 data79 data80 data9".split()
    assert keys(kv.prefix(state, "data5")) == ["data54"]
    assert keys(kv.prefix(state, "dat2")) == ["dat222"]
    assert keys(kv.between(state, "b", "data1")) == ["b", "c", "dat1", "dat222", "data1"]
    assert kv.get(log, "data1").first()["v"] == "val15"
    assert kv.live(log).count() == 16


def test_range_must_grow(log):
    for low, high in (("b", "b"), ("c", "b")):
        with pytest.raises(ValueError):
            kv.between(log, low, high)


def test_delete_keeps_the_value_and_ignores_unknown_keys(spark, log):
    marks = spark.createDataFrame([("b", 1000, 100), ("nothing", 1000, 101)], "k string, ts_us long, lsn long")
    after = kv.delete(log, marks)
    assert [(r["k"], r["v"]) for r in kv.deleted(after).collect()] == [("b", "val1")]
    assert "b" not in keys(kv.live(after)) and "b" not in keys(kv.purge(after))
    again = kv.put(after, spark.createDataFrame([("b", "new", 2000, 102)], "k string, v string, ts_us long, lsn long"))
    assert kv.get(again, "b").first()["tomb"] == 0


def test_pages_cover_the_state_once(log):
    state = kv.newest(log)
    pages = [keys(kv.page(state, p, 5)) for p in (1, 2, 3, 4, 5)]
    assert sum(pages, []) == keys(state) and pages[4] == [] and keys(kv.page(state, 0, 5)) == pages[0]


def test_compaction_does_not_bring_old_versions_back(spark):
    old = spark.createDataFrame([("a", "1", 1, 0, 1), ("b", "1", 2, 0, 2)], "k string, v string, ts_us long, tomb int, lsn long")
    new = spark.createDataFrame([("a", "1", 5, 1, 3), ("b", "2", 2, 0, 4)], "k string, v string, ts_us long, tomb int, lsn long")
    merged = compaction.merge(old, new)
    assert [tuple(r) for r in compaction.without_deletes(merged).collect()] == [("b", "2")]


def test_level_plan_loses_nothing():
    plan = compaction.plan_levels(40, 5, 4)
    for flush in range(1, 41):
        assert sum(n for f, _, n in plan if f == flush) == 5 * flush


def test_replay_is_the_newest_state(log):
    assert sorted(map(tuple, wal.replay(log, 5, 2).collect())) == sorted(map(tuple, kv.newest(log).select("k", "v", "tomb").collect()))


def test_positions_in_a_total_order(spark):
    names = [f"{i * 7919 % 1000:04d}x" for i in range(1000)] + ["", "é", "zz", "\U0001f600"]
    df = spark.createDataFrame([(n, len(n)) for n in names], "k string, n int").repartition(7)
    order = sorted(names, key=lambda x: x.encode())
    assert [r["k"] for r in ranks.numbered(df, ["k"], "at", 8).orderBy("at").collect()] == order
    total, want = 0, {}
    for n in order:
        want[n] = total
        total += len(n)
    assert {r["k"]: r["s"] for r in ranks.running(df, ["k"], "n", "s", 8).collect()} == want
    assert ranks.numbered(df.limit(0), ["k"], "at").count() == 0


def test_record_layout(spark):
    rows = spark.createDataFrame([("b", "xy"), ("a", "x"), ("é", "")], "k string, v string")
    found = {r["k"]: r for r in sstable.layout(rows).collect()}
    assert found["a"]["offset"] == 48 and found["b"]["offset"] == 48 + 31 and found["é"]["record_size"] == 31
    assert found["é"]["crc"] == zlib.crc32("é".encode())


def test_fnv(spark):
    def plain(data: bytes) -> int:
        h = 2166136261
        for b in data:
            h = h * 16777619 % 2**32 ^ b
        return h

    texts = ["", "a", "foobar", "é", "12345"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in found} == {t: plain(t.encode()) for t in texts}


def test_bloom_has_no_false_negatives(spark):
    added = spark.range(0, 2000, 7).select(F.col("id").cast("string").alias("key"))
    filter_, sized = bloom.build(added, [], 50, 0.1)
    found = {int(r["key"]): r["maybe"] for r in bloom.probe(filter_, sized, spark.range(2000).select(F.col("id").cast("string").alias("key"))).collect()}
    assert all(found[i] for i in range(0, 2000, 7))
    assert sum(found[i] for i in found if i % 7) < 0.2 * len(found)


@pytest.mark.parametrize("n", [1, 4, 5, 33, 100])
def test_merkle_in_steps(spark, n):
    rows = spark.range(n).select(F.lit(1).alias("g"), "id", F.col("id").cast("string").alias("t"))
    leaves = merkle.leaves(rows, "g", "id", F.col("t"))
    level = [hashlib.sha1(str(i).encode()).digest() for i in range(n)]
    while len(level) < 4 or len(level) & (len(level) - 1):
        level.append(bytes(20))
    while len(level) > 1:
        level = [hashlib.sha1(a + b).digest() for a, b in zip(level[::2], level[1::2], strict=True)]
    for step in (2, 3, 10):
        assert merkle.roots(leaves, step).first()["root"] == level[0].hex()


def test_lru_by_chunks(spark):
    trace = [(i, str(i * i % 23 if i % 3 else i % 11)) for i in range(500)]
    df = spark.createDataFrame(trace, "at long, k string")
    for capacity in (1, 5, 16):
        held, want = [], []
        for _, k in trace:
            want.append(int(k in held))
            held = [k, *(x for x in held if x != k)][:capacity]
        for chunk in (7, 100, 1000):
            assert [r["hit"] for r in cache.hits(df, capacity, chunk).orderBy("at").collect()] == want
        assert [r["k"] for r in cache.final_state(df, capacity).orderBy("recency").collect()] == held


def test_limiter_admits_one_more_after_a_refill(spark):
    at = [0, 1, 2, 3, 100, 101, 102, 103, 104]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(at)], "key string, id long, at long")
    ok = [r["ok"] for r in limiter.admit(df, 3, 60, 5).orderBy("id").collect()]
    assert ok == [1, 1, 1, 0, 1, 1, 1, 1, 0]


def test_sketches_bound_their_counts(spark):
    df = spark.range(3000).select((F.col("id") * F.col("id") % 97).cast("string").alias("k"))
    exact = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    found = sketches.cms_estimates(sketches.cms(df, F.col("k"), 50, 3), df.select("k").distinct(), 50, 3).collect()
    assert all(r["est"] >= exact[r["k"]] for r in found)


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_distinct_values_carry_no_sketch_each(spark):
    """Aggregates by value hold the value alone; a sketch of 1,639 words for each one filled memory and disk."""
    found = sketches.approx_distinct(spark.range(1000), "id")
    plan = list(_nodes(found._jdf.queryExecution().sparkPlan()))
    by_value = [n for n in plan if n.nodeName().endswith("Aggregate") and n.groupingExpressions().size()]
    assert by_value and all(n.output().size() == 1 for n in by_value)


@pytest.mark.parametrize(
    ("kind", "rows", "exact"),
    [
        ("double", [0.0, -0.0, float("nan"), -float("nan"), 1.5, 1.5, None, float("inf")], 4),
        ("string", ["", "a", "A", "a ", "a", None, None], 4),
        ("array<int>", [[], [1, 2], [2, 1], [1, 2], None], 3),
        ("long", [None, None], 0),
        ("long", [], 0),
        ("long", [i % 20011 for i in range(60000)], 20011),
    ],
)
def test_distinct_values_and_their_estimate(spark, kind, rows, exact):
    df = spark.createDataFrame([((x,), i) for i, x in enumerate(rows)], f"s struct<`_value`: {kind}>, _value int").repartition(3)
    found = sketches.approx_distinct(df, "s._value").first()
    assert found["exact"] == exact
    assert found["est"] == df.agg(F.approx_count_distinct("s._value", 0.01)).first()[0]
    assert abs(found["est"] - exact) <= 0.05 * exact


def test_simhash(spark):
    docs = spark.createDataFrame([(0, "The cat, the hat."), (1, "the cat the hat"), (2, None), (3, "")], "doc_id long, text string")
    h = {r["doc_id"]: r["h"] for r in simhash.fingerprint(docs).collect()}
    assert h[0] == h[1] and h[2] == h[3] == "0" * 256
    assert all(x == "0" for x in h[0][::8])
    assert {r["dist"] for r in simhash.next_distance(simhash.fingerprint(docs)).where("a = 0 or a = 2").collect()} == {0}


def test_numbering_of_keys_with_a_common_prefix(spark):
    """Ranges follow the keys themselves, so a long common prefix does not put all rows into one."""
    names = [f"{'x' * 40}{i:06d}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in names], "k string").repartition(5)
    found = ranks.numbered(df, ["k"], "at", 16)
    assert [r["k"] for r in found.orderBy("at").collect()] == names
    assert found.groupBy(F.floor(F.col("at") / 1000)).count().count() == 3


def test_flushes_of_updates(spark):
    rows = [("s", k, i + 1) for i, k in enumerate("a a b a c a b d d e".split())]
    found = memtable.flushes(spark.createDataFrame(rows, "store string, k string, lsn long"), 3).orderBy("generation").collect()
    assert [tuple(r)[1:] for r in found] == [(0, 3, 5, 1, 5), (1, 3, 3, 6, 8), (2, 2, 2, 9, 10)]


def test_damaged_records_fail(spark):
    log = spark.createDataFrame([(1, 0, "k", "v", 1), (2, 0, "k", None, 2)], "ts_us long, tomb int, k string, v string, lsn long")
    stored = wal.encode(log)
    assert [r["ok"] for r in wal.verify(stored).orderBy("lsn").collect()] == [1, 1]
    for column, value in (("v", "w"), ("k", "l"), ("ts_us", 7), ("tomb", 1)):
        assert [r["ok"] for r in wal.verify(stored.withColumn(column, F.lit(value))).collect()].count(0) >= 1

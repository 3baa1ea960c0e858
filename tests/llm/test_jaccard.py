import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siltbed.llm import jaccard

from .conftest import documents, edge_rows


def brute(rows, size, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(own)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


def check(spark, scratch, rows, size=3, percent=80, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similar_documents(df, scratch, size=size, percent=percent, **more).collect()
    roots, sets = brute(rows, size, percent)
    assert len(found) == len(rows)
    for r in found:
        assert r["component_id"] == roots[r["doc_id"]], r
        assert r["n_shingles"] in {len(x) for x in sets[r["doc_id"]]}


def copies(seed, base_words, groups, each, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [str(rng.randrange(3000)) for _ in range(base_words)]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = str(rng.randrange(3000))
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


def batches(rows, names, types, sizes):
    at = 0
    for k in [*sizes, len(rows)]:
        own = rows[at : at + k]
        at += k
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], t) for i, t in enumerate(types)], names=names)


@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(1, 40), st.integers(8, 12)), max_size=120, unique_by=lambda r: r[:2]), st.integers(1, 40), st.lists(st.integers(0, 9), max_size=20))
@settings(max_examples=200, deadline=None)
def test_lists_in_parts_give_the_pairs_of_whole_lists(rows, chunk, sizes):
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    found, lists = set(), Counter()
    for out in jaccard._pair_up(80, 2, chunk)(batches(rows, ["s", "gid", "n"], [pa.int64(), pa.int64(), pa.int32()], sizes)):
        for a, b, kind in zip(*(out.column(i).to_pylist() for i in range(3)), strict=True):
            if kind:
                lists[a, b] += 1
            else:
                found.add((a, b))
    of = {}
    for s, gid, n in rows:
        of.setdefault(s, []).append((gid, n))
    assert lists == Counter((s, gid) for s, own in of.items() if len(own) > 8 for gid, _ in own)
    assert found == {(min(a, b), max(a, b)) for own in of.values() if len(own) <= 8 for i, (a, n) in enumerate(own) for b, m in own[i + 1 :] if 100 * n >= 80 * m}


@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(0, 20), max_size=30)), max_size=12), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_frequent_keys_are_counted_in_parts(rows, most):
    rows = [(p, *(y.astype(np.uint32).tobytes() for y in np.unique(np.array(keys, np.uint32), return_counts=True))) for p, keys in sorted(rows)]
    out = jaccard._count(2, most)(batches(rows, ["part", "keys", "times"], [pa.int32(), pa.binary(), pa.binary()], [1, 2]))
    found = Counter()
    want = {}
    for own in out:
        for key, n in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
            found[key, n] += 1
    for part, keys, times in rows:
        for k, n in zip(np.frombuffer(keys, np.uint32).tolist(), np.frombuffer(times, np.uint32).tolist(), strict=True):
            want.setdefault(part, Counter())[k] += n
    assert found == Counter((k, n) for own in want.values() for k, n in own.items() if n > 2)


def test_small_groups(spark, scratch):
    check(spark, scratch, copies(1, 40, 40, 4, 4))


def test_large_groups_go_through_pools(spark, scratch):
    check(spark, scratch, copies(2, 60, 2, 90, 6), over=4, cell=16)


def test_common_passage_is_no_link(spark, scratch):
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, shared + " " + " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    check(spark, scratch, rows, over=4, cell=32)


def test_ids_beyond_what_is_sent(spark, scratch):
    check(spark, scratch, copies(4, 30, 20, 3, 3), known=0)


def test_edges(spark, scratch):
    rows = edge_rows()
    found = jaccard.similar_documents(documents(spark, rows), scratch, size=5, percent=80).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    assert by[None]["component_id"] is None and by[None]["n_shingles"] == 1
    assert by[5]["component_id"] == 4 and by[6]["component_id"] == 6
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i for i in (1, 2, 3))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(empty, scratch).count() == 0


def test_lists_of_several_components(spark, scratch):
    """Cells of two sets leave most links to the meetings of components within lists."""
    check(spark, scratch, copies(7, 60, 3, 60, 7), over=4, cell=2)
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(50)]
    rows = [(i, " ".join(shared + [str(rng.randrange(10**6)) for _ in range(i % 13)])) for i in range(200)]
    check(spark, scratch, rows, over=4, cell=4)


def test_work_on_a_large_group_is_linear(spark):
    """Rows that meet in cells, for 500 and 2,000 near copies of one text."""
    from siltbed.llm.scratch import Scratch

    made = []
    for n in (500, 2000):
        kept = Scratch(spark, "linear")
        drop, kept.drop = kept.drop, lambda *names: None
        rows = copies(9, 100, 1, n, 2)
        found = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), kept, size=4, percent=80)
        assert found.where("component_id = 0").count() >= 0.99 * n
        read = lambda name: spark.read.parquet(f"{kept.root}/{name}")  # noqa: B023, E731
        made.append(read("near").count() + (0 if read("several").isEmpty() else read("more").count()))
        drop("near", "more", "several")
    assert made[1] <= 5 * made[0]

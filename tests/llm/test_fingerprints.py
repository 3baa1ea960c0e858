import hashlib

from siltbed.llm import fingerprints as fp

from .conftest import documents, edge_rows


def phrases(text):
    seen, p = set(), ""
    for c in text:
        p += c
        if p not in seen:
            seen.add(p)
            p = ""
    return seen | ({p} if p else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, found, k):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = by[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        exact = jaccard(phrases(t), phrases(edited)), jaccard(phrases(t), phrases(after))
        few = max(map(len, (phrases(t), phrases(edited), phrases(after)))) <= k // 2
        for x, y in zip(exact, (r["near_edited"], r["near_next"]), strict=True):
            assert abs(x - y) < (1e-9 if few else 0.25)


def test_fingerprints(spark):
    rows = [(i * 3, ("abcab" * (i % 5) + f" text {i} of many words, né {i * i}") * (i % 4)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for ranges in (1, 4, 50):
        check(spark, rows, fp.fingerprints(df, ranges=ranges).collect(), 128)


def test_edges(spark):
    rows = [r for n, r in enumerate(edge_rows()) if n != 7]
    found = fp.fingerprints(documents(spark, rows)).collect()
    check(spark, [r[:2] for r in rows], found, 128)
    by = {r["doc_id"]: r for r in found}
    assert by[4]["fingerprint"] == by[5]["fingerprint"] and by[4]["near_next"] == 1.0
    twice = fp.fingerprints(documents(spark, edge_rows())).where("doc_id = 6").collect()
    assert len(twice) == 2 and twice[0]["fingerprint"] == twice[1]["fingerprint"]
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_null_ids_beside_large_ones(spark):
    """Ids above 2^53, one null id or many: no row is lost and each edited text is right, over any ranges."""
    big = [((1 << 53) + 3 * i + 1, f"text {i} " * (i % 7)) for i in range(400)] + [((1 << 63) - 1, "the last"), (-(1 << 63), "the first")]
    for rows in ([*big, (None, "no id")], [(None, f"none {i}") for i in range(50)] + big[:50]):
        lost = sorted((t for i, t in rows if i is None), key=lambda t: spark.sql(f"select xxhash64('{t}')").first()[0])
        order = lost + [t for _, t in sorted(r for r in rows if r[0] is not None)]
        want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(n + 1) % len(order)][: len(t) // 2]).encode()).hexdigest() for n, t in enumerate(order))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        for ranges in (1, 4, 50):
            assert sorted(r["edited_sha256"] for r in fp.fingerprints(df, ranges=ranges).collect()) == want

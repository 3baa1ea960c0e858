import collections
import re

from siltbed.llm import quality

from .conftest import documents, edge_rows

WORD = r"[^\x20\x09-\x0D]+"


def brute(t):
    t = t or ""
    w = re.findall(WORD, t)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_counts_and_verdicts(spark, scratch):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in quality.quality_rules(docs, labels, scratch).collect()}
    for r in docs.select("doc_id", "text").collect():
        own = found[r["doc_id"]]
        counts = brute(r["text"])
        assert tuple(own[c] for c in quality.COUNTS) == counts
        assert own["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (own["base_failed"] and own["kept"])
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [found[i]["kept"] for i, q in marks.items() if q == 1 and not found[i]["base_failed"]]
    bad = [found[i]["kept"] for i, q in marks.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_edges(spark, scratch):
    rows = edge_rows()
    marks = [(1, 1), (1, 0), (None, 1), (4, None), (777, 1), (4, 1), (9, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = quality.quality_rules(documents(spark, rows), labels, scratch).collect()
    assert len(found) == len(rows)
    for r, (_, t, *_) in zip(sorted(found, key=lambda r: (r["doc_id"] or -1, r["n_words"])), sorted(rows, key=lambda r: r[0] or -1), strict=True):
        assert tuple(r[c] for c in quality.COUNTS) == brute(t)
    none = quality.quality_rules(documents(spark, rows), labels.limit(0), scratch).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert quality.quality_rules(documents(spark, rows).limit(0), labels, scratch).count() == 0

import re
from collections import defaultdict

from siltbed.llm import mixing

from .conftest import documents, edge_rows


def fill(sizes, weights, most):
    names = sorted(sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = sum(w[k] for k in names if k not in capped)
        rest = total - sum(most * sizes[k] for k in capped)
        target = {k: most * sizes[k] if k in capped else w[k] * rest / free for k in names}
        over = {k for k in names if k not in capped and target[k] > most * sizes[k]}
        if not over:
            return target
        capped |= over


def test_targets_and_samples(spark, scratch):
    rows = [(i, "w " * (1 + i * 37 % 200), "en", f"s{(i % 11) ** 2 % 9}" if i % 50 else None) for i in range(3000)]
    found = mixing.mix(documents(spark, rows), scratch).collect()
    assert len(found) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        key = "1" if r["source"] is None else "0" + r["source"]
        sizes[key] += r["size"]
        taken[key] += r["taken"]
        target[key] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    want = fill(sizes, (5, 2, 1), 3)
    for k, t in want.items():
        assert abs(target[k] - t) < 1e-6 * t and abs(taken[k] - t) < 0.02 * t + 10
    again = mixing.mix(documents(spark, rows).repartition(3), scratch).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_edges(spark, scratch):
    rows = edge_rows()
    found = mixing.mix(documents(spark, rows), scratch).collect()
    assert len(found) == len(rows)
    assert sorted(r["size"] for r in found) == sorted(len(re.findall(mixing.WORD, t or "")) for _, t, *_ in rows)
    assert mixing.mix(documents(spark, rows).limit(0), scratch).count() == 0
    blank = mixing.mix(documents(spark, [(1, "", None, "a"), (2, None, None, "b")]), scratch).collect()
    assert [(r["taken"], r["target"]) for r in blank] == [(0, 0.0)] * 2

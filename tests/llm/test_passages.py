import random

from siltbed.llm import passages
from siltbed.llm.scratch import Scratch

from .conftest import documents, edge_rows


def text(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    shared, near = text(rng, 60), text(rng, 160)
    rows, want = [], set()
    for i in range(120):
        own = text(rng, rng.randrange(0, 300))
        if i % 10 == 3:
            at = rng.randrange(len(own) + 1)
            own = own[:at] + shared + own[at:]
            want.add(i)
        if i % 20 == 7:
            edited = list(near)
            edited[rng.randrange(160)] = "edited"
            own = own + edited
            want.add(i)
        rows.append((i, " ".join(own), "en", "a"))
    return rows, want


def test_planted_passages(spark, scratch):
    rows, want = corpus()
    for known in (1 << 22, 0):
        found = passages.near_passages(documents(spark, rows), scratch, known=known).collect()
        assert {r["doc_id"] for r in found} == want - {3, 7}
        words = {i: t.lower().split() for i, t, *_ in rows}
        for r in found:
            assert r["of_doc_id"] < r["doc_id"] and r["end"] - r["start"] >= 50 and r["jaccard"] >= 0.8
            a = {tuple(words[r["doc_id"]][k : k + 5]) for k in range(r["start"], r["end"] - 4)}
            b = {tuple(words[r["of_doc_id"]][k : k + 5]) for k in range(r["of_start"], r["of_end"] - 4)}
            assert abs(len(a & b) / len(a | b) - r["jaccard"]) < 1e-6


def test_dropping(spark, scratch):
    rows, _ = corpus(2)
    docs = documents(spark, rows)
    left = passages.drop_passages(docs, passages.near_passages(docs, scratch)).cache()
    assert left.count() == len(rows)
    assert passages.near_passages(left, Scratch(spark, "left")).count() == 0


def test_compact_windows_hold_each_minimum():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.permutation(60).astype(np.uint64)
    found = passages.compact_windows(values, 10)
    for a in range(60):
        for b in range(a + 9, 60):
            c = a + int(values[a : b + 1].argmin())
            assert sum(l <= a <= m <= b <= r for l, m, r in found if m == c) == 1


def test_edges(spark, scratch):
    rows = edge_rows()
    found = passages.near_passages(documents(spark, rows), scratch).collect()
    assert {(r["doc_id"], r["of_doc_id"]) for r in found} == {(5, 4)}
    assert passages.near_passages(documents(spark, rows).limit(0), scratch).count() == 0


def test_passages_around_frequent_phrases(spark, scratch):
    """Pairs that share 60 words of which a phrase of 300 other documents is the larger part."""
    rng = random.Random(3)
    phrase = text(rng, 40)
    rows = [(i, " ".join(text(rng, 40) + phrase + text(rng, 40)), "en", "a") for i in range(300)]
    want = {}
    for k in range(120):
        cut = k % 21
        shared = text(rng, cut) + phrase + text(rng, 20 - cut)
        for half in (0, 1):
            rows.append((1000 + 2 * k + half, " ".join(text(rng, 30) + shared + text(rng, 30)), "en", "a"))
        want[1001 + 2 * k] = 1000 + 2 * k
    found = passages.near_passages(documents(spark, rows).repartition(3), scratch).collect()
    assert {(r["doc_id"], r["of_doc_id"]) for r in found} == set(want.items())


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_recall_of_edited_passages(spark, scratch):
    """Of 200 passages of 100 words with two words edited, all pairs at 0.8 or more count; unrelated texts share nothing."""
    rng = random.Random(5)
    rows, want = [], set()
    for k in range(200):
        own = text(rng, 100)
        other = list(own)
        for at in rng.sample(range(100), 2):
            other[at] = f"edited{k}"
        a, b = shingles(own), shingles(other)
        if len(a & b) >= 0.8 * len(a | b):
            want.add((2 * k + 1, 2 * k))
        rows += [(2 * k, " ".join(text(rng, 80) + own + text(rng, 70)), "en", "a"), (2 * k + 1, " ".join(text(rng, 50) + other + text(rng, 90)), "en", "a")]
    found = {(r["doc_id"], r["of_doc_id"]) for r in passages.near_passages(documents(spark, rows), scratch).collect()}
    assert len(found & want) >= 0.95 * len(want) and len(want) > 100


def test_result_does_not_depend_on_partitions(spark, scratch):
    rng = random.Random(6)
    base, rows = text(rng, 70), []
    for i in range(60):
        own = list(base)
        if i % 3:
            own[rng.randrange(70)] = f"edited{i}"
        rows.append((i, " ".join(text(rng, 40) + own + text(rng, 40)), "en", "a"))
    runs = [sorted(map(tuple, passages.near_passages(documents(spark, rows).repartition(n), scratch).collect())) for n in (1, 3, 12)]
    assert runs[0] == runs[1] == runs[2] and len({r[0] for r in runs[0]}) == 59


def test_runs_are_the_longest():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        shared = rng.random(60) < 0.9
        best = max(((j - i) for i in range(60) for j in range(i + 20, 61) if shared[i] and shared[j - 1] and 20 * shared[i:j].sum() >= 160 * (~shared[i:j]).sum()), default=0)
        found = [b - a for a, b in passages.runs(shared, 20, 80)]
        assert (found[0] if found else 0) == best


def exact(rows):
    """Words of each document within a stretch of 46 shingles or more of which enough are an earlier document's, by brute force."""
    import numpy as np

    words = {i: t.lower().split() for i, t, *_ in rows}
    own = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in words.items()}
    out = {}
    for x in own:
        for y in own:
            if y >= x or len(set(own[x]) & set(own[y])) < 37:
                continue
            place = {s: k for k, s in enumerate(own[y])}
            for a, b in passages.runs(np.array([s in place for s in own[x]]), 46, 80):
                at = [place[s] for s in own[x][a:b] if s in place]
                mine, other = set(own[x][a:b]), set(own[y][min(at) : max(at) + 1])
                if len(mine & other) >= 0.8 * len(mine | other):
                    out.setdefault(x, set()).update(range(a, b + 4))
    return out


def lost(spark, scratch, rows):
    """(documents with passages, those of which words of passages are in no row)."""
    left = exact(rows)
    whole = len(left)
    for r in passages.near_passages(documents(spark, rows), scratch).collect():
        if r["doc_id"] in left:
            left[r["doc_id"]] -= set(range(r["start"], r["end"]))
    return whole, sorted(x for x in left if left[x])


def test_passages_of_a_template_with_two_slots(spark, scratch):
    """All documents share three phrases, but only those with both slots alike have a passage in common."""
    rng = random.Random(7)
    a, b, c = (text(rng, 17) for _ in range(3))
    slots = [[[f"slot{n}x{k}x{w}" for w in range(2)] for k in range(12)] for n in range(2)]
    rows = [(i, " ".join([*text(rng, 60), *a, *rng.choice(slots[0]), *b, *rng.choice(slots[1]), *c, *text(rng, 60)]), "en", "a") for i in range(300)]
    whole, without = lost(spark, scratch, rows)
    assert whole > 100 and not without


def test_windows_on_several_diagonals(spark, scratch):
    """A word more and a word less move the windows of one passage to the next diagonal, which begin before those of the first one."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        own = text(rng, 360)
        other = list(own)
        other.insert(200, f"more{k}")
        del other[300:303]
        other.insert(120, f"more{k}")
        rows += [(2 * k, " ".join(own), "en", "a"), (2 * k + 1, " ".join(other), "en", "a")]
    whole, without = lost(spark, scratch, rows)
    assert whole == 40 and not without


def test_links_of_large_groups_are_those_of_all_comparisons(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    near = rng.integers(0, 4, (90, len(passages.PLACES))).astype("<u2")
    near[:, 4] = 7
    doc = np.sort(rng.integers(0, 60, 90))
    every = np.arange(90)
    want = set()
    for i in every:
        sets = {}
        for j in every[:i]:
            if doc[i] != doc[j]:
                sets.setdefault(frozenset(np.flatnonzero((near[i] == near[j]) & (near[i] != 0)).tolist()), j)
        want |= {(i, j) for m, j in sets.items() if len(m) > 1 and not any(m < n for n in sets)}
    found = set()
    for group, at_once in ((1 << 10, 1 << 17), (1 << 10, 1 << 8), (20, 1 << 10)):
        monkeypatch.setattr(passages, "GROUP", group)
        monkeypatch.setattr(passages, "AT_ONCE", at_once)
        found = {(int(i), int(j)) for a, b in passages._linked(near, doc, [every]) for i, j in zip(a, b, strict=True) if doc[i] != doc[j]}
        assert want <= found


def test_large_groups_are_not_compared_in_full(monkeypatch):
    """Windows of a passage that documents repeat with edits: the links of all comparisons, with a small part of them."""
    import numpy as np

    rng = np.random.default_rng(9)
    n, places = 2000, len(passages.PLACES)
    near = np.full((n, places), 7, "<u2")
    for _ in range(2):
        at = rng.integers(0, places, n)
        near[np.arange(n), at] = np.where(rng.random(n) < 0.5, 100 + rng.integers(0, 40, n), 1000 + np.arange(n))
    near[np.arange(places) < rng.integers(0, 4, n)[:, None]] = 0
    doc = np.sort(rng.integers(0, 200, n))
    want = set()
    for i in range(n):
        before = int(np.searchsorted(doc, doc[i]))
        masks = ((near[:before] == near[i]) & (near[i] != 0)) @ (1 << np.arange(places))
        each, first = np.unique(masks, return_index=True)
        want |= {(i, int(j)) for m, j in zip(each, first, strict=True) if m and not ((each & m == m) & (each != m)).any()}
    compared, masks_of = 0, passages._masks

    def counted(near, low, high):
        nonlocal compared
        compared += len(near) * (high - low) * high
        return masks_of(near, low, high)

    monkeypatch.setattr(passages, "_masks", counted)
    found = {(int(i), int(j)) for a, b in passages._linked(near, doc, [np.arange(n)]) for i, j in zip(a, b, strict=True)}
    assert found == want and compared < n * n / 10

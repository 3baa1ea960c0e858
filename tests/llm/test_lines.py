from siltbed.llm import lines

from .conftest import CLASHES, documents, edge_rows


def build():
    rows = []
    for i in range(40):
        own = ["unique " + " ".join(chr(97 + i % 26) * (k + 1) + "z" * (i // 26) for k in range(8))]
        if i % 2 == 0:
            own.insert(0, "Subscribe to our newsletter today")
        if i % 4 == 1:
            own.append(f"Posted by user{i} on 2024-01-{i:02d} with {i * 7} views")
        if i % 4 == 3:
            own.append(f"Shared with friends by {'abcdefghij'[i % 10] * 4} from the editorial office of the daily paper")
        rows.append((i, "\n".join(own), "en", "a"))
    return rows


def test_recurring_templates_stay_once(spark, scratch):
    rows = build()
    for known in (1 << 20, 0):
        found = {r["doc_id"]: r for r in lines.dedup_lines(documents(spark, rows), scratch, documents=5, known=known).collect()}
        assert len(found) == 40
        text = "\n".join(r["text"] for r in found.values())
        assert text.count("Subscribe") == 1 and "Subscribe" in found[0]["text"]
        assert text.count("Posted by") == 1 and "Posted by" in found[1]["text"]
        assert text.count("Shared with") == 1 and "Shared with" in found[3]["text"]
        assert text.count("unique ") == 40
        assert found[2]["n_dropped"] == 1 and found[2]["n_lines"] == 2


def test_large_leaves_are_split(spark, scratch):
    rows = build() + [(100 + i, "the one " + " ".join("abcdefghijklmnopqrstuvwxyz"[(i + k) % 26] * (i + 1) for k in range(4)), "en", "a") for i in range(60)]
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, rows), scratch, documents=5, leaf=10).collect()}
    assert all(found[i] == t for i, t, *_ in rows if i >= 100)
    assert sum("Subscribe" in t for t in found.values()) == 1


def names(n):
    """n words without a digit."""
    return ["name" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(n)]


def test_templates_of_more_lines_than_a_leaf_compares(spark, scratch):
    rows = [(i, f"unique text {x}\nPosted by {x} in the forum of our town", "en", "a") for i, x in enumerate(names(1200))]
    found = lines.dedup_lines(documents(spark, rows), scratch).collect()
    assert sum("Posted by" in r["text"] for r in found) == 1


def test_a_leaf_of_any_size_drops_alike(spark, scratch):
    for n in (1000, 1001, 50_000):
        rows = [(i, f"Shared with {x} from the editorial office of the daily paper", "en", "a") for i, x in enumerate(names(n))]
        found = lines.dedup_lines(documents(spark, rows).repartition(4), scratch)
        assert found.where("n_dropped = 1").count() == n - 1


def test_long_lines_are_judged_whole(spark, scratch):
    """Lines of 160 tokens that agree in each tenth one, and in the first ones, alone."""
    words = names(160 * 30)
    rows = [(i, " ".join(f"same{'abcdefghijklmnop'[k // 10]}" if k % 10 == 0 or k < 2 else words[160 * i + k] for k in range(160)), "en", "a") for i in range(30)]
    assert lines.dedup_lines(documents(spark, rows), scratch, documents=2).where("n_dropped > 0").count() == 0


def test_tree_against_a_plain_one(spark, scratch):
    """Templates of random lines of a few words, one line at a time in the order of their masked hashes."""
    import random

    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(["the", "one", *(rng.choice(["a", "b", "c", "d", f"{rng.randrange(9)}"]) for _ in range(6))]) for _ in range(4)), "en", "a") for i in range(80)]
    made = list(lines._lines(iter([documents(spark, rows).select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]])))
    masked = {}
    for batch in made:
        for r in batch.to_pylist():
            if r["leaf"] is not None:
                masked[r["masked"]] = r["tokens"], r["leaf"]
    heads, want = [], {}
    field = int(lines._FIELD >> lines.U(48)).to_bytes(2, "little")
    for key, (tokens, leaf) in sorted(masked.items(), key=lambda x: (x[1][1], x[0])):
        own, best = [tokens[i : i + 2] for i in range(0, len(tokens), 2)], None
        for head in heads:
            if head["leaf"] != leaf:
                continue
            same = [a == b for a, b in zip(head["form"], own, strict=True)]
            if sum(s and x != field for s, x in zip(same, own, strict=True)) >= max(lines.CONSTANT, len(own) / 2) and sum(same) >= 0.6 * len(own) and (best is None or sum(same) > best[0]):
                best = sum(same), head, same
        if best:
            best[1]["form"] = [x if s else None for s, x in zip(best[2], best[1]["form"], strict=True)]
            want[key] = best[1]["key"]
        else:
            heads.append({"key": key, "form": own, "leaf": leaf})
    lines.recurring_lines(documents(spark, rows), scratch, documents=2)
    known = spark.read.parquet(f"{scratch.root}/known").select("line", "template").distinct().collect()
    of = {r["line"]: r["masked"] for batch in made for r in batch.to_pylist()}
    assert want and {r["line"]: r["template"] for r in known} == {x: want.get(m, m) for x, m in of.items()}


def test_lines_without_constants_stay(spark, scratch):
    """Rows of numbers, dates and short sentences are dropped only where they are equal."""
    words = names(40)
    rows = [(i, f"{i * 37} {i * 91}.5 {i}/7\nIt was {words[i]}\nPage {i}\n17 18 19\nRow {words[i]} {i} {i + 1} {i + 2} {i + 3}", "en", "a") for i in range(40)]
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, rows), scratch).collect()}
    assert found[0] == rows[0][1]
    assert all(found[i] == t.replace("17 18 19\n", "") for i, t, *_ in rows[1:])


def test_long_lines_recur_in_two_documents(spark, scratch):
    long, short = " ".join(names(50)), " ".join(names(49))
    rows = [(i, f"own text {names(9)[i]}\n{long}\n{short}" if i in (3, 7) else f"own text {names(9)[i]}", "en", "a") for i in range(9)]
    for known in (1 << 20, 0):
        found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, rows), scratch, known=known).collect()}
        assert found == {i: t.replace(f"\n{long}", "") if i == 7 else t for i, t, *_ in rows}


def test_looked_up_templates_are_those_compared():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 7, 16):
        tokens = [bytes(2 * size)] + [rng.zipf(1.5, size).clip(0, 60000).astype("<u2").tobytes() for _ in range(800)]
        batch = pa.RecordBatch.from_pydict({"leaf": [1] * 801, "masked": [*range(801)], "tokens": tokens})
        made = [[b.to_pydict() for b in lines._templates(0.6, direct)(iter([batch]))] for direct in (0, 10, 10_000)]
        assert made[0] == made[1] == made[2]


def test_edges(spark, scratch):
    rows = edge_rows()
    made = lines.dedup_lines(documents(spark, rows), scratch, documents=2)
    assert set(CLASHES) <= set(made.columns)
    found = made.collect()
    assert len(found) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in found}
    assert texts[None] == "no id at all here" and texts[1] is None and texts[2] == "" and texts[3] == " \n\t "
    assert texts[4] and texts[5] == "" and [r["text"] for r in found if r["doc_id"] == 6] == ["the same words again"] * 2
    assert lines.dedup_lines(documents(spark, rows).limit(0), scratch).count() == 0

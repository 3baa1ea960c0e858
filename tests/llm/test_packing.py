import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltbed.llm import packing, queries

from .conftest import documents, edge_rows


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_best_fit_is_best_fit_decreasing(counts):
    moves = packing.best_fit(counts, 50)
    used, placed = {}, {}
    for length, low, high, first, offset in moves:
        for k in range(high - low):
            used.setdefault(first + k, []).append((offset, length))
            placed.setdefault(length, []).append(low + k)
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in counts.items()}
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 50
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(50 - length)
    assert len(used) == len(gaps)


@given(st.lists(st.text(alphabet=st.sampled_from(list("aZé́'sd 1\n\t 　İΣß<|>endoftx.!\U0001f600")), max_size=60), max_size=20))
@settings(max_examples=150, deadline=None)
def test_ids_by_parts_are_the_text_s(texts):
    encode = packing.Encoder(queries.vocabulary())
    plain = packing._tokenizer(queries.vocabulary())
    texts += ["a<|endoftext|>b <|startoftext|>", "don't I'LL 12 x"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == plain.encode(text, add_special_tokens=False).ids


def test_pack(spark, scratch):
    rng = random.Random(5)
    rows = edge_rows() + [(100 + i, " ".join(rng.choices("alpha beta gamma delta 42 !".split(), k=rng.randrange(200))), "en", "a") for i in range(300)]
    found = packing.pack(documents(spark, rows), scratch, tokenizer=queries.vocabulary(), capacity=128, chunk=16).toPandas()
    plain = packing._tokenizer(queries.vocabulary())
    want = []
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(-1 if i is None else i, k // 128, k, len(ids[k : k + 128]), zlib.crc32(np.array(ids[k : k + 128], "<u4").tobytes())) for k in range(0, len(ids), 128)]
    got = found.fillna({"doc_id": -1})
    assert sorted(want) == sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False)))
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 128
    assert found["sequence_id"].nunique() <= 1.1 * -(-found["length"].sum() // 128) + 1
    empty = packing.pack(spark.createDataFrame([], "doc_id long, text string"), scratch, tokenizer=queries.vocabulary())
    assert empty.count() == 0

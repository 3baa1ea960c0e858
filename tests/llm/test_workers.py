from __future__ import annotations

import gc

import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from siltbed.llm import jaccard, language, lines, packing, queries
from siltbed.llm import words as W

from .conftest import documents

TEXT = "some words that a worker takes apart, one after another\n"


@pytest.fixture
def tasks(spark, scratch, monkeypatch):
    """What the pipeline's operators hand to mapInArrow, by operator."""
    docs = documents(spark, [(i, TEXT * (i % 3 + 1), "en" if i % 2 else "fr", "a") for i in range(40)])
    found, now, real = {}, "", DataFrame.mapInArrow

    def seen(self, run, schema, *rest, **more):
        found.setdefault(now, []).append(run)
        return real(self, run, schema, *rest, **more)

    monkeypatch.setattr(DataFrame, "mapInArrow", seen)
    for now, made in {
        "pack": lambda: packing.pack(docs, scratch, tokenizer=queries.vocabulary()),
        "language": lambda: language.identify(docs, docs.doc_id >= 0, keep=["doc_id"]),
        "lines": lambda: lines.dedup_lines(docs, scratch),
        "near": lambda: jaccard.similar_documents(docs, scratch),
    }.items():
        made()
    return found


def batch(texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "siltbed_text": pa.array(texts)})


def encoders() -> int:
    gc.collect()
    return sum(isinstance(x, packing.Encoder) for x in gc.get_objects())


def test_a_task_of_another_operator_lets_the_tokenizer_go(tasks):
    cut, place = tasks["pack"]
    for other in (tasks["language"][0], tasks["lines"][0], tasks["near"][0], place):
        for _ in range(2):
            assert len(list(cut(iter([batch([TEXT])])))) == 1
            assert encoders() == 1  # kept from task to task of its own
        list(other(iter([])))
        assert encoders() == 0


def test_tasks_give_back_what_they_freed(tasks, monkeypatch):
    given = []
    if W._trim:
        real = W._trim
        monkeypatch.setattr(W, "_trim", lambda n: (given.append(n), real(n))[1])
    for runs in tasks.values():
        for run in runs:
            before = len(given)
            list(run(iter([])))
            assert len(given) == before + bool(W._trim)

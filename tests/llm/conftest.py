from __future__ import annotations

import pytest

from siltbed.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for own columns.
CLASHES = ["n", "key", "size", "score", "word", "hit", "kept", "copies", "rank", "_id", "n_words", "n_dropped", "lang_pred", "chunk", "target", "name", "host"]


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) as documents, with columns that clash."""
    from pyspark.sql import functions as F

    full = [(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000))


def edge_rows():
    """Nulls in each column, empty and very long texts, ties and repeated rows."""
    return [
        (None, "no id at all here", None, None),
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \n\t ", "en", None),
        (4, LONG, "en", "b"),
        (5, LONG, "en", "b"),
        (6, "the same words again", "en", "a"),
        (6, "the same words again", "en", "a"),
        (7, "été à la plage 12 ### | \U0001f600", "fr", "a"),
        (8, "x", "de", "c"),
        (9, "### 123 $$$", "de", "c"),
    ]

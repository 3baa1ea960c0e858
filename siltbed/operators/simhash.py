"""SimHash over 256 bits: the ASCII bits of each token's MD5 in hex."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: one of these goes from a token's end.
MARKS = ",.!?:;"


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, tok, n: tokens between single spaces, one mark dropped from the end, lower-cased, none empty."""
    words = docs.select("doc_id", F.explode(F.split("text", " ")).alias("w")).where("w != ''")
    tok = F.lower(F.regexp_replace("w", r"[,.!?:;]\z", ""))
    return words.groupBy("doc_id", tok.alias("tok")).agg(F.count("*").alias("n"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, h: 256 characters 0 or 1. A text is folded where it is read, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                counts = Counter((w[:-1] if w[-1] in MARKS else w).lower() for w in (text or "").split(" ") if w)
                total = np.zeros(256, np.int64)
                names, times = list(counts), np.array(list(counts.values()), np.int64)
                for i in range(0, len(names), 4096):
                    digests = b"".join(hashlib.md5(x.encode()).hexdigest().encode() for x in names[i : i + 4096])  # noqa: S324
                    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 256).astype(np.int64)
                    total += (times[i : i + 4096, None] * (2 * bits - 1)).sum(axis=0)
                out.append("".join("1" if x > 0 else "0" for x in total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h string")


def hamming(left: str, right: str):  # noqa: ANN201
    """The number of places in which two columns of bit strings differ."""
    return F.length(F.regexp_replace(F.translate(F.concat_ws("", F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: F.when(a == b, "0").otherwise("1"))), "0", ""), "[^1]", ""))


def next_distance(prints: DataFrame) -> DataFrame:
    """a, b, dist: the distance of each fingerprint to that of the next doc_id."""
    other = prints.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("h2"))
    return prints.join(other, "doc_id").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), hamming("h", "h2").cast("int").alias("dist"))

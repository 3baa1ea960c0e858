"""Document fingerprints: minimum hashes of a document's Lempel-Ziv phrases."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import set_batches

U = np.uint64
_R, _powers = 0xD1342543DE82EF95, [np.ones(1, U), np.ones(1, U)]


class Parse:
    """An LZ78 parse that can go on with one ending, be taken back, and go on with another."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.node = self.root

    def read(self, text: str, start: int, journal: list | None = None) -> list[int]:
        """Ends of the phrases in text, which begins at position start of the document."""
        root, node, cuts = self.root, self.node, []
        for i, c in enumerate(text, start + 1):
            below = node.get(c)
            if below is None:
                node[c] = {}
                if journal is not None:
                    journal.append((node, c))
                cuts.append(i)
                node = root
            else:
                node = below
        self.node = node
        return cuts


def _phrases(text: str, cuts: list[int]) -> np.ndarray:
    """Distinct hashes, sorted, of the phrases of a text that end at cuts; what is left over is one more."""
    n = len(text)
    if not n:
        return np.empty(0, U)
    if len(_powers[0]) <= n:
        for i, base in enumerate((_R, pow(_R, -1, 2**64))):
            steps = np.full(max(2 * n, 1 << 16), base, U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    sums = np.zeros(n + 1, U)
    np.cumsum(W.mix(codes + U(0x632BE59BD9B4E019)) * _powers[0][:n], out=sums[1:])
    ends = np.array(cuts if cuts and cuts[-1] == n else [*cuts, n], np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    return np.unique(W.mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(U)))


def likeness(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity of two phrase sets by their k smallest hashes; two empty sets are alike."""
    both = np.unique(np.concatenate([a, b]))[:k]
    if not len(both):
        return 1.0
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).mean())


def as_text(low: np.ndarray) -> str:
    return base64.b64encode((low >> U(32)).astype(">u4").tobytes()).decode()


def _record(doc: int | None, text: str, cuts: list[int], low: np.ndarray, head: Parse, after: str, after_low: np.ndarray, k: int) -> tuple:
    """The row of a document, given the text and minimum hashes of the next one."""
    half = len(text) - len(text) // 2
    tail = after[: len(text) // 2]
    edited = text[:half] + tail
    edited_low = _phrases(edited, [x for x in cuts if x <= half] + head.read(tail, half))[:k]
    return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(low), as_text(edited_low), likeness(low, edited_low, k), likeness(low, after_low, k)


def _begin(text: str, k: int) -> tuple[list[int], np.ndarray, Parse]:
    """Phrase ends and minimum hashes of a text, and its parse taken back to the first half."""
    head, half, journal = Parse(), len(text) - len(text) // 2, []
    cuts = head.read(text[:half], 0)
    node = head.node
    cuts += head.read(text[half:], half, journal)
    for at, c in reversed(journal):
        del at[c]
    head.node = node
    return cuts, _phrases(text, cuts)[:k], head


def fingerprints(docs: DataFrame, *, k: int = 128, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    A text is parsed into Lempel-Ziv (LZ78) phrases of code points; the fingerprint has the k smallest hashes of
    its set of phrases (32 bits of each, in base64), and likeness is the Jaccard similarity these estimate
    (exact for sets of k phrases or fewer). The edited text has the last half (rounded down) of the
    code points replaced by the first as many of the next document in the order of doc_id, the last
    one's next being the first. Text moves once: documents are dealt in ranges of ids, each with a
    copy of the first document of the next range at its end; a task walks its ranges in order.

    Null texts count as empty; two empty ones have likeness 1, an empty and another 0. Rows with equal
    ids follow each other in the order of a hash of the text, null ids come first, dealt out by
    the same hash. A table of one row is its
    own next document, an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    set_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = ranges or 3 * parts
    found = [] if n < 2 else read.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)
    bounds = np.unique([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in found]).astype(np.int64)
    hashed = 1 << max(n - 1, 0).bit_length()  # ranges of null ids, by the hash of the text

    def ranged(ids: pd.Series, lost: pd.Series, hashes: pd.Series) -> np.ndarray:
        own = np.searchsorted(bounds, ids.to_numpy(np.int64), "right") + hashed
        part = ((hashes.to_numpy(np.int64) >> 32) + (1 << 31)) * hashed >> 32
        return np.where(lost.to_numpy(bool), part, own)

    @F.pandas_udf("long")
    def place(ids: pd.Series, lost: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranged(ids, lost, hashes))

    # Ids and hashes reach Python without nulls, as those would turn them into floats.
    keys = [F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), F.xxhash64("text")]
    firsts = read.select(place(*keys).alias("r"), F.when(F.isnull("doc_id"), F.xxhash64("text")).otherwise(F.col("doc_id")).alias("least")).groupBy("r").agg(F.min("least").alias("least")).collect()  # a row for each range
    firsts = sorted((r["r"], r["least"]) for r in firsts)
    at, least = np.zeros(hashed + len(bounds) + 1, np.int64), np.zeros(hashed + len(bounds) + 1, np.int64)
    for i, (r, x) in enumerate(firsts):
        at[r], least[r] = i, x

    @F.pandas_udf("long")
    def deal(ids: pd.Series, lost: pd.Series, hashes: pd.Series) -> pd.Series:
        """Twice the range's number, and 1 for a range's first id."""
        r = ranged(ids, lost, hashes)
        return pd.Series(2 * at[r] + (np.where(lost, hashes, ids).astype(np.int64) == least[r]))

    last = max(len(firsts) - 1, 0)
    code = read.withColumn("code", deal(*keys)).withColumn("r", F.col("code").bitwiseAND(F.lit(-2)) / 2)
    own = F.struct(F.col("r").cast("int").alias("r"), F.lit(0).alias("tail"))
    copy = F.struct(F.when(F.col("r") == 0, last).otherwise(F.col("r") - 1).cast("int").alias("r"), F.lit(1).alias("tail"))
    dealt = code.select("doc_id", "text", F.explode(F.when(F.col("code") % 2 == 1, F.array(own, copy)).otherwise(F.array(own))).alias("p")).select("doc_id", "text", "p.r", "p.tail")
    dealt = dealt.repartition(parts, "r").sortWithinPartitions("r", "tail", F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, -1  # the row before, and the range that has met its end
        for batch in batches:
            out = []
            for doc, text, r, tail in zip(*(W.column_of(batch, c).to_pylist() for c in ("doc_id", "text", "r", "tail")), strict=True):
                if r == done:
                    continue
                cuts, low, head = _begin(text, k)
                if held:
                    out.append(_record(*held, text, low, k))
                held = None if tail else (doc, text, cuts, low, head)
                done = r if tail else done
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return dealt.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

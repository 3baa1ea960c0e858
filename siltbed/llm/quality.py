"""Quality rules: an isolation forest over rule statistics, its threshold set from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, set_batches

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rates in 0..1 that the trees split on.
RATES = ["symbol_rate", "upper_rate", "digit_rate", "mark_rate", "dup_line_rate", "repeat_rate", "word_length"]
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATES)
BINS = 4096


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _mask(SYMBOLS), _mask(bytes(range(65, 91))), _mask(b"0123456789")
_LETTER = _mask(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]))
_MARK = _mask(b"!?;:=~^_+@\\/{}[]")
_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)]) & ~W.SPACES


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and rates of whole texts."""
    names = [x.split()[0] for x in STATS.split(", ")]
    types = [pa.int64()] * 6 + [pa.float64()] * len(RATES)
    for batch in batches:
        ids, texts = W.column_of(batch, "doc_id"), W.column_of(batch, "text")
        for part in W.split(texts, lower=False):
            at = part.bounds
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[part.data])])[at])  # noqa: B023, E731
            words = np.diff(part.rows)
            keys, begins = W.shingles(part, 3, whole=False)
            made = np.diff(begins)
            row = np.repeat(np.arange(len(part)), made)
            _, where, found = np.unique(W.mix(keys + row.astype(W.U) * W.U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            again = np.flatnonzero(found[where] > 1)
            word = part.rows[:-1][row[again]] + again - begins[:-1][row[again]]
            covered = np.zeros(len(part.hashes) + 3, bool)
            for i in range(3):
                covered[word + i] = True
            repeated = np.diff(np.concatenate([[0], np.cumsum(covered)])[part.rows])
            dup, lines = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for i in range(len(part)):
                own = [x for x in part.data[at[i] : at[i + 1]].tobytes().split(b"\n") if x.strip()]
                lines[i], dup[i] = len(own), len(own) - len(set(own))
            points, letters = total(_POINT), np.maximum(total(_LETTER), 1)
            each = np.maximum(words, 1)
            rate = lambda x, y: np.minimum(x / np.maximum(y, 1), 1.0)
            rates = [rate(total(_SYMBOL), each), rate(total(_UPPER), letters), rate(total(_DIGIT), points), rate(total(_MARK), each), rate(dup, lines), rate(repeated, each), rate(points / each, 25)]
            columns = [words, points, total(_SYMBOL), dup, repeated, *rates]
            yield pa.record_batch([ids.slice(part.first, len(part)), *(pa.array(x, t) for x, t in zip(columns, types[1:], strict=True))], names)


def _fold(n: float) -> float:
    """Mean path length of a search tree of n points that was not split further."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(clean: np.ndarray, every: np.ndarray, trees: int, sample: int, depth: int, seed: int) -> list[tuple]:
    """Trees of random splits. A split falls anywhere in the node's box of all rows; a branch ends
    where at most one of the tree's clean rows is left, so regions without clean rows end early."""
    rng = np.random.default_rng(seed)
    low, high = every.min(axis=0), every.max(axis=0)
    wide = np.flatnonzero(high > low)
    forest = []
    for _ in range(trees):
        own = clean[rng.choice(len(clean), min(sample, len(clean)), replace=False)]
        feature, cut, left, right, value = [], [], [], [], []

        def grow(rows: np.ndarray, box: list, level: int) -> int:
            node = len(feature)  # noqa: B023
            for x in (feature, cut, left, right, value):  # noqa: B023
                x.append(0)
            value[node] = level + _fold(len(rows))  # noqa: B023
            left[node] = right[node] = node  # noqa: B023
            feature[node], cut[node] = 0, np.inf  # noqa: B023
            if len(rows) <= 1 or level >= depth or not len(wide):
                return node
            f = int(rng.choice(wide))
            at = rng.uniform(box[f][0], box[f][1])
            feature[node], cut[node] = f, at  # noqa: B023
            below = rows[:, f] <= at
            left[node] = grow(rows[below], [(a, min(b, at)) if i == f else (a, b) for i, (a, b) in enumerate(box)], level + 1)  # noqa: B023
            right[node] = grow(rows[~below], [(max(a, at), b) if i == f else (a, b) for i, (a, b) in enumerate(box)], level + 1)  # noqa: B023
            return node

        grow(own, list(zip(low, high, strict=True)), 0)
        forest.append((np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)))
    return forest


def anomaly(forest: list[tuple], rows: np.ndarray, sample: int, depth: int) -> np.ndarray:
    """0..1 for each row, larger where the mean path is shorter."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for feature, cut, left, right, value in forest:
        node = np.zeros(len(rows), np.int64)
        for _ in range(depth):
            node = np.where(rows[every, feature[node]] <= cut[node], left[node], right[node])
        total += value[node]
    return np.exp2(-total / len(forest) / max(_fold(sample), 1.0)) if forest else np.zeros(len(rows))


def quality_rules(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, fit_rows: int = 8192, trees: int = 64, sample: int = 256, depth: int = 14, clean_kept: float = 0.995, seed: int = 7) -> DataFrame:
    """doc_id, counts, base_failed, score, kept of every document.

    The forest is fitted on about fit_rows labelled rows (those with a hash under a threshold), or all if there are fewer.
    The threshold comes from the scores of all labelled rows: of those that keep the share clean_kept
    of quality 1, the one with the best mean of kept clean and dropped junk. kept is false where the
    basic rules fail (under 50 words; more than half of the words in repeated 3-word windows) or the
    score is above the threshold. A null or empty text has zero counts and fails; null labels and
    labels of no document are ignored; without labels of both kinds the score drops nothing. Rows with
    equal ids are judged one by one. Other columns are not read.
    """
    set_batches(docs.sparkSession)
    stats = scratch.save(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(statistics, STATS), "stats")
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
    marked = stats.join(marks, stats.doc_id == marks._id).where(F.col("n_words") > 0)
    # About fit_rows rows by a hash threshold, so that no task gathers a sample of every other one.
    drawn = F.xxhash64("doc_id", *RATES, F.lit(seed))
    share = min(1.0, fit_rows / max(marked.count(), 1))
    rows = marked.where(F.pmod(drawn, F.lit(1 << 30)) < int(share * (1 << 30))).select(*RATES, "_quality", drawn.alias("_h"), "doc_id").toPandas().sort_values(["_h", "doc_id", *RATES], ignore_index=True)
    every, good = rows[RATES].to_numpy(float), rows["_quality"].to_numpy() == 1
    forest = fit_forest(every[good], every, trees, sample, depth, seed) if good.any() and not good.all() else []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([W.column_of(batch, c).to_numpy(zero_copy_only=False) for c in RATES])
            yield pa.RecordBatch.from_arrays([*(W.column_of(batch, c) for c in ["doc_id", *COUNTS]), pa.array(anomaly(forest, x, sample, depth))], names=["doc_id", *COUNTS, "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    scored = scratch.save(stats.mapInArrow(judge, schema), "scored")
    most = 1.0
    if forest:
        pairs = scored.join(marks, scored.doc_id == marks._id).where(F.col("n_words") > 0)
        counted = pairs.groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), "_quality").count().collect()  # at most 2 (BINS + 1) rows
        table = np.zeros((BINS + 2, 2))
        for r in counted:
            table[r["bin"], r["_quality"]] += r["count"]
        clean = np.cumsum(table[:, 1]) / table[:, 1].sum()
        caught = 1 - np.cumsum(table[:, 0]) / table[:, 0].sum()
        gain = np.where(clean >= clean_kept, clean + caught, -1)
        best = np.flatnonzero(gain == gain.max())
        most = (best[len(best) // 2] + 1) / BINS
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") < F.lit(float(most))))

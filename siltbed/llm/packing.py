"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, set_batches

#: Words whose ids a worker remembers, of about 200 bytes each.
REMEMBERED = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenizer(path: str):  # noqa: ANN202
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Latin letters between ASCII marks: the tokenizer takes each run of marks as one part and the letters as
#: another, unless an apostrophe stands before letters or a special token is spelled out.
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_names() -> dict[int, str]:
    """How a byte-level tokenizer spells these letters: printable bytes as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    parts between spaces and newlines, one after another; each part is tokenized once and remembered.
    New parts of Latin letters, lower-cased as the tokenizer does, go to its merges directly.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.marks = _tokenizer(path), {"": b""}, {"": b""}
        self.names = _byte_names()

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[text] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.marks[text]

    def _learn(self, parts: set[str]) -> None:
        merge, known, odd = self.tokenizer.model.tokenize, self.known, []
        for x in parts:
            m = _PLAIN.fullmatch(x)
            if not m or "<|" in x:
                odd.append(x)
                continue
            before, word, after = m.groups()
            word = word.lower()
            own = known.get(word)
            if own is None:
                own = known[word] = array("I", [t.id for t in merge(word if word.isascii() else word.translate(self.names))]).tobytes()
            if x != word:
                known[x] = self._mark(before) + own + self._mark(after)
        for x, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[x] = array("I", found.ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        parts = [(x or "").replace("\n", " ").split(" ") for x in texts]
        found = [list(map(self.known.get, x)) for x in parts]
        missing = [[i for i, x in enumerate(own) if x is None] if None in own else [] for own in found]
        self._learn({own[i] for own, lost in zip(parts, missing, strict=True) for i in lost})
        for own, have, lost in zip(parts, found, missing, strict=True):
            for i in lost:
                have[i] = self.known[own[i]]
        return [b"".join(x) for x in found]


def _encoder(path: str) -> Encoder:
    """A worker's own, kept from task to task of pieces_of()."""
    return W.kept(f"encoder {path}", lambda: Encoder(path))


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each document: its ids and end_id, cut after every `capacity` ids."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            texts = W.column_of(batch, "text").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(W.column_of(batch, "doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for values, x in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(W.lean(cut, keep=f"encoder {tokenizer}"), PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces go: (length, rank from, rank to, first sequence, offset).

    Pieces of one length are interchangeable, and so are sequences with one gap, so a round moves
    intervals of ranks: it takes the longest pieces left, sweeps the gaps upwards from the first
    that holds them (the successor), gives each gap's sequences to the lowest ranks that have none
    yet, as many as they hold, and puts the lessened gaps back in order for the next round. What no gap holds opens new
    sequences. The result is that of best-fit decreasing. The table has at most `capacity` lengths
    and 2 runs of sequences for each length, whatever the number of documents.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    gaps: list[int] = []
    moves = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                n = -(-(total - rank) // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            gap = gaps[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                gaps.pop(at)
            # No other gap lies between this one and what a piece leaves of it, so it takes all it can hold.
            each = gap // length
            full = min(n, (total - rank) // each)
            rest = min(total - rank - full * each, each) if full < n else 0
            for sequences, to, slots in ((full, first, each), (min(rest, 1), first + full, rest)):
                for slot in range(slots if sequences else 0):
                    moves.append((length, rank, rank + sequences, to, capacity - gap + slot * length))
                    rank += sequences
                put(gap - slots * length, to, sequences)
            used = full + min(rest, 1)
            put(gap, first + used, n - used)
    return moves


def pack(docs: DataFrame, scratch: Scratch, *, tokenizer: str, capacity: int = 2048, end_id: int = 0, chunk: int = 1 << 14) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    Documents are tokenized once; the lengths of pieces are counted (at most `capacity` different
    ones), best_fit() decides on intervals of ranks, and pieces, range-sorted by length, get their
    ranks in chunks of about `chunk` rows so that a common length is dealt over many tasks. A null
    or empty text is one piece with end_id alone. Rows with equal ids are packed one by one; ties
    are ordered by doc_id, piece and checksum, so reruns give the same places to equal rows. An empty
    table packs into nothing. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    set_batches(spark)
    pieces = scratch.save(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    moves = np.array(sorted(best_fit(counts, capacity)), np.int64).reshape(-1, 5)
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, -(-max(counts.values(), default=1) // chunk)))))
    sizes = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.repartitionByRange(parts, "length", "chunk").withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.join(sizes, ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    table = spark.sparkContext.broadcast(moves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = table.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            if not len(batch):
                continue
            length, rank = (W.column_of(batch, c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length.astype(np.int64) << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(W.column_of(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(plan[at, 3] + rank - plan[at, 1]), pa.array(plan[at, 4])], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(W.lean(place), f"{PIECES}, sequence_id long, offset long")

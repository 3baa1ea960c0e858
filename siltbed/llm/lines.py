"""Line dedup: a fixed-depth template tree over lines; templates that recur across documents are dropped."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, set_batches

U = np.uint64
#: Leading tokens that lead to a leaf: the tree's depth.
DEPTH = 2
#: Tokens that all lines of a template have in place and that are no fields: so many at least, and half of all tokens.
CONSTANT = 3
_FIELD = U(0x5F2A91C3D4E6B807)  # the hash of a variable field
LINES = "doc_id long, line long, leaf long, masked long, tokens binary, words int"


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line.strip()) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with a word: its hash, its leaf, its masked hash, 16 bits of each token and their count.

    A token with a digit is a variable field. Leaves hold lines of one token count. A line of too few constant tokens
    for a template has its own hash for the masked one, and no leaf."""
    names = [x.split()[0] for x in LINES.split(", ")]
    digit = np.zeros(256, bool)
    digit[48:58] = True
    for batch in batches:
        ids = W.column_of(batch, "doc_id")
        data, bounds = W.text_bytes(W.column_of(batch, "text"))
        at = 0
        while at < len(batch):
            to = min(len(batch), max(at + 1, int(np.searchsorted(bounds, bounds[at] + W.CHUNK, "right")) - 1))
            own, rows = data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            ends = np.unique(np.concatenate([np.flatnonzero(own == 10) + 1, rows[1:]]))
            cuts = np.concatenate([[0], ends[ends > 0]])
            part = W._split(own, cuts, 0, lower=False)
            count = np.diff(part.rows)
            full = np.flatnonzero(count)
            if len(full):
                digits = np.concatenate([[0], np.cumsum(digit[own])])
                tokens = np.where(digits[part.ends] > digits[part.starts], _FIELD, part.hashes)
                n, begin = count[full], part.rows[:-1][full]
                padded = np.concatenate([tokens, np.zeros(DEPTH + 1, U)])
                leaf = n.astype(U)
                for i in range(DEPTH):
                    leaf = W.mix(leaf * U(31) + np.where(n > i, padded[np.minimum(begin + i, len(tokens))], U(7)))
                place = np.arange(len(tokens)) - np.repeat(part.rows[:-1], count)
                masked = W.mix(np.add.reduceat(W.mix(tokens + place.astype(U) * U(0x9E3779B97F4A7C15)), begin) + n.astype(U)).view(np.int64)
                short = (tokens >> U(48)).astype("<u2").tobytes()
                text = own.tobytes()
                hashes = [line_hash(text[cuts[i] : cuts[i + 1]]) for i in full]
                constant = np.add.reduceat((tokens != _FIELD).astype(np.int64), begin)
                bare = (constant < CONSTANT) | (2 * constant < n)
                masked = np.where(bare, np.array(hashes, np.int64), masked)
                doc = np.searchsorted(rows, cuts[:-1][full], "right") - 1 + at
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(hashes, pa.int64()), pa.array(leaf.view(np.int64), mask=bare), pa.array(masked), W.binary([b"" if x else short[2 * i : 2 * (i + m)] for i, m, x in zip(begin.tolist(), n.tolist(), bare.tolist(), strict=True)]), pa.array(n, pa.int32())], names=names)
            at = to


def _templates(alike: float, direct: int):  # noqa: ANN202
    """Rows (leaf, masked, tokens) sorted by leaf: (masked, template) of lines that join another's template.

    A line is compared to all templates of its leaf up to `direct` of them. Of more, those are looked up that have one of
    its tokens in place among as many places as may differ and one more, so none that is alike is passed over."""

    field = int(_FIELD >> U(48))

    def group(masked: list[int], lines: list[bytes]) -> list[tuple[int, int]]:
        own = np.frombuffer(b"".join(lines), "<u2").reshape(len(lines), -1)
        size = own.shape[1]
        forms, fixed = np.empty_like(own), np.zeros(own.shape, bool)
        heads, joined, at = [], [], {}
        needed = next(k for k in range(size + 1) if k / size >= alike or k == size)
        # The last places, as all lines of a leaf agree in the first ones.
        shift, places = np.arange(needed - 1, size) << 32, slice(needed - 1, size)

        def index(head: int) -> None:
            for key in (forms[head, places] + shift).tolist():
                at.setdefault(key, []).append(head)

        for key, tokens in zip(masked, own, strict=True):
            n = len(heads)
            if n <= direct:
                some = np.arange(n)
            else:
                found = (at.get(x, ()) for x in (tokens[places] + shift).tolist())
                some = np.unique(np.fromiter(chain.from_iterable(found), np.int64))
            if len(some):
                same = (forms[some] == tokens) & fixed[some]
                constant = (same & (tokens != field)).sum(axis=1)
                score = np.where((constant >= CONSTANT) & (2 * constant >= size), same.sum(axis=1) / size, 0.0)
                best = int(score.argmax())
                if score[best] >= max(alike, 1e-9):
                    fixed[some[best]] = same[best]
                    joined.append((key, heads[some[best]]))
                    continue
            forms[n], fixed[n] = tokens, True
            heads.append(key)
            if n == direct:
                for head in range(n):
                    index(head)
            if n >= direct:
                index(n)
        return joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, masked, lines = None, [], []
        for batch in batches:
            out = []
            for leaf, key, tokens in zip(*(W.column_of(batch, c).to_pylist() for c in ("leaf", "masked", "tokens")), strict=True):
                if leaf != now:
                    if len(masked) > 1:
                        out += group(masked, lines)
                    now, masked, lines = leaf, [], []
                masked.append(key)
                lines.append(tokens)
            yield _two(out)
        yield _two(group(masked, lines) if len(masked) > 1 else [])

    def _two(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["masked", "template"])

    return run


def recurring_lines(docs: DataFrame, scratch: Scratch, *, documents: int = 10, alike: float = 0.6, leaf: int = 1000, words: int = 50, copies: int = 2) -> DataFrame:
    """(line, first): hash of each line whose template occurs in `documents` documents or more, or which has `words` words
    or more and itself occurs in `copies` documents or more, and the first of these.

    Lines are led to a leaf by their token count and two leading tokens, where a token with a digit
    is a variable field. Within a leaf a line joins the template that shares most of its
    tokens, `alike` of them at least, and where they differ the template gets a field. CONSTANT tokens and half of all
    must be none: lines of fewer (numbers, dates, two words) recur only where they are equal. Equal masked lines are one
    before that. Leaves are the same at every size of the corpus: in one of more than `leaf` templates a line looks up
    those it may join by its tokens, with the same result.
    """
    set_batches(docs.sparkSession)
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = scratch.save(read.mapInArrow(W.lean(_lines), LINES), "lines")
    masked = lines.groupBy("masked").agg(F.min("leaf").alias("leaf"), F.min("tokens").alias("tokens"))
    dealt = masked.where("leaf is not null").select("leaf", "masked", "tokens").repartition("leaf").sortWithinPartitions("leaf", "masked")
    joined = scratch.save(dealt.mapInArrow(W.lean(_templates(alike, leaf)), "masked long, template long"), "joined")
    known = lines.select("doc_id", "line", "masked", (F.col("words") >= words).alias("long")).join(joined, "masked", "left").select("doc_id", "line", F.coalesce("template", "masked").alias("template"), "long")
    known = scratch.save(known.distinct(), "known")
    scratch.drop("lines", "joined")
    often = known.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= documents)
    equal = known.where("long").select("line", "doc_id").distinct().groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= copies)
    # The key is written as a sum, so that the lines are dealt out anew and those of a common template can be split.
    often = often.select((F.col("template") + F.lit(0)).alias("template"), "first")
    both = known.join(often, "template").select("line", "first").union(equal.select("line", "first"))
    return scratch.save(both.groupBy("line").agg(F.min("first").alias("first")), "found")


def dedup_lines(docs: DataFrame, scratch: Scratch, *, documents: int = 10, alike: float = 0.6, leaf: int = 1000, words: int = 50, copies: int = 2, known: int = 1 << 20) -> DataFrame:
    """The columns of docs, with recurring lines gone from text, then n_lines and n_dropped.

    A line whose template occurs in `documents` documents or more, or a line of `words` words or more that is in
    `copies` documents or more, stays in the first of these (by
    doc_id) and is dropped from all others. Up to `known` recurring lines are sent to the
    scan that rewrites texts; more are joined by document. Null texts stay null, lines without a word stay; rows with a null
    doc_id are returned as they are and count for nothing; rows with equal ids count as one
    document. A document may end up empty. Own columns named n_lines or n_dropped are replaced.
    """
    found = recurring_lines(docs, scratch, documents=documents, alike=alike, leaf=leaf, words=words, copies=copies)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*rest)
    if found.count() <= known:
        table = found.toArrow()
        order = np.argsort(table["line"].to_numpy())
        sent = docs.sparkSession.sparkContext.broadcast((table["line"].to_numpy()[order], table["first"].to_numpy()[order]))
        read = docs.withColumn("siltbed_drop", F.lit(None).cast("array<long>"))
    else:
        sent = None
        pairs = docs.sparkSession.read.schema("doc_id long, line long, template long").parquet(f"{scratch.root}/known").join(found, "line").where("doc_id != first")
        read = docs.join(pairs.groupBy(F.col("doc_id").alias("siltbed_id")).agg(F.collect_set("line").alias("siltbed_drop")), F.col("doc_id") == F.col("siltbed_id"), "left").drop("siltbed_id")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, drops = (W.column_of(batch, c).to_pylist() for c in ("doc_id", "text", "siltbed_drop"))
            owns = [(x or "").encode().split(b"\n") for x in column]
            hashes = np.array([line_hash(x) for own in owns for x in own], np.int64)
            ends = np.cumsum([len(x) for x in owns])
            if sent is not None:
                lines, firsts = sent.value
                at = np.minimum(np.searchsorted(lines, hashes), max(len(lines) - 1, 0))
                docs_ = np.repeat(np.array([0 if x is None else x for x in ids], np.int64), np.diff(ends, prepend=0))
                gone = (lines[at] == hashes) & (firsts[at] != docs_) if len(lines) else np.zeros(len(hashes), bool)
            texts, total, dropped = [], [], []
            for doc, text, own, drop, end in zip(ids, column, owns, drops, ends.tolist(), strict=True):
                mine = slice(end - len(own), end)
                if doc is None:
                    out = []
                elif sent is not None:
                    out = np.flatnonzero(gone[mine]).tolist()
                else:
                    out = np.flatnonzero(np.isin(hashes[mine], drop)).tolist() if drop else []
                total.append(sum(1 for x in own if x.strip()))
                dropped.append(len(out))
                if out:
                    lost = set(out)
                    text = b"\n".join(x for i, x in enumerate(own) if i not in lost).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == "text" else W.column_of(batch, c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=[*rest, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    return read.mapInArrow(W.lean(rewrite), schema)

"""Substring dedup: near-duplicate passages by compact windows over minimum hashes of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, set_batches

U = np.uint64
#: A hit of two windows (kind 0), the first window of a class (1, in y) or a window that has a class (2, in x). v is the
#: value, with the hash function in its last bits, or the class.
HITS = "kind byte, x long, y long, xl int, xc int, xr int, yl int, yc int, yr int, v long"
#: Windows that a task holds before it looks for equal ones, or for those that meet.
HELD = 1 << 18
#: Shingles whose hash is one context of a window, and where these begin, counted from the window's minimum: what lies up to
#: 45 shingles off is covered without a gap, so windows that differ there differ in a context.
SEGMENT = 5
PLACES = (*range(-45, 0, SEGMENT), *range(1, 46, SEGMENT))
REACH = 45
#: Contexts that a passage of the least width agrees in, wherever its minimum and one edited word are.
STRONG = 5
#: Windows that are all compared with each other; more are first split by their contexts, where that helps.
GROUP = 1 << 7
#: Comparisons that are held at once.
AT_ONCE = 1 << 17


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r): each subsequence of `least` values or more, from l..c to c..r, has its minimum at c.

    These are the nodes of the values' Cartesian tree that span `least` or more; the others are not visited.
    """
    out, stack = [], [(0, len(values) - 1)] if len(values) >= least else []
    while stack:
        l, r = stack.pop()
        c = l + int(values[l : r + 1].argmin())
        out.append((l, c, r))
        if c - l >= least:
            stack.append((l, c - 1))
        if r - c >= least:
            stack.append((c + 1, r))
    return out


def _first(keys: np.ndarray) -> np.ndarray:
    """The first row of each row's key."""
    _, first, own = np.unique(keys, return_index=True, return_inverse=True)
    return first[own]


def _classes(v: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A hash of each window's value and all of its contexts. Windows of one class are alike for 45 shingles on both sides."""
    out = W.mix(v.view(U) + U(0x51AFD7ED558CCD6D))
    for k in range(near.shape[1]):
        out = W.mix(out * U(31) + near[:, k].astype(U))
    return out


def _contexts(own: np.ndarray) -> np.ndarray:
    """The hash of the SEGMENT shingles from each place on, the first REACH places before the text; 0 if all are beyond its ends."""
    beside = np.concatenate([np.zeros(REACH, U), own, np.zeros(REACH + SEGMENT, U)])
    out = np.zeros(len(own) + 2 * REACH + 1, U)
    for k in range(SEGMENT):
        out = W.mix(out * U(31) + beside[k : k + len(out)])
    out = np.maximum((out >> U(48)).astype("<u2"), 1)
    out[: REACH - SEGMENT + 1] = 0
    out[REACH + len(own) :] = 0
    return out


def _masks(near: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each group (first axis) and each of its windows low..high-1 with those up to high a bit for each context in which
    these agree; 0 agrees with nothing."""
    out = np.zeros((len(near), high - low, high), np.int32)
    for k in range(near.shape[2]):
        own = near[:, :, k]
        some = np.flatnonzero(own.any(1))
        if len(some):
            own = own[some].astype(np.int32)
            own = np.where(own, own, -1 - np.arange(own.shape[1], dtype=np.int32))
            same = (own[:, low:high, None] == own[:, None, :high]) * np.int32(1 << k)
            if len(some) == len(out):
                out |= same
            else:
                out[some] |= same
    return out


def _widest(row: np.ndarray, other: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, other): of each row, sorted with its others, the first one of each mask that no other mask of the row contains."""
    key = row.astype(np.int64) << len(PLACES) | mask
    _, first = np.unique(key, return_index=True)
    row, other, mask = row[first], other[first], mask[first]
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    sizes = np.diff(np.append(begins, len(row)))
    begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    keep = np.ones(len(row), bool)
    ends = np.cumsum(size)
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
        a = np.repeat(np.arange(low, high), size[low:high])
        steps = np.cumsum(size[low:high]) - size[low:high]
        b = begin[a] + np.arange(len(a)) - np.repeat(steps, size[low:high])
        keep[a[(a != b) & (mask[a] & ~mask[b] == 0)]] = False
        low = high
    return row[keep], other[keep]


def _shared(near: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The contexts, but 0 for those that no other row of the group has or all rows of it have."""
    sizes = np.bincount(group)[group]
    out = np.zeros(near.shape, near.dtype)
    for k in range(near.shape[1]):
        _, own, count = np.unique(group << 16 | near[:, k], return_inverse=True, return_counts=True)
        count = count[own]
        np.copyto(out[:, k], near[:, k], where=(count > 1) & (count < sizes))
    return out


def _agree(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of rows a bit for each context in which these agree."""
    out = np.zeros(len(i), np.int32)
    for k in range(own.shape[1]):
        a = own[i, k]
        out |= ((a == own[j, k]) & (a != 0)) * np.int32(1 << k)
    return out


def _compared(own: np.ndarray, doc: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of groups of one size, a group's rows in each row of the table, by comparing all of them."""
    size = table.shape[1]
    step = max(1, AT_ONCE // (size * size))
    block = size if size * size <= AT_ONCE else max(1, AT_ONCE // size)
    for at in range(0, len(table), step):
        rows = table[at : at + step]
        contexts = own[rows]
        for low in range(0, size, block):
            high = min(low + block, size)
            mask = _masks(contexts, low, high)
            g, i, j = np.nonzero(mask * np.tri(high - low, high, low - 1, dtype=bool))
            mask = mask[g, i, j]
            i += low
            pick = doc[rows[g, i]] != doc[rows[g, j]]
            row, other = _widest((g * size + i)[pick], j[pick], mask[pick])
            yield rows[row // size, row % size], rows[row // size, other]


def _split(own: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(mask, parts, sizes): a bit for each context in which a row has its group's most frequent value, and the rows of each other
    value that two rows have, of all contexts one after another, but those that all have one such value beside it, too."""
    n, places = len(rows), own.shape[1]
    own = own[rows]
    mask, count, orders, edges = np.zeros(n, np.int32), np.zeros((n, places), np.int64), [], []
    for k in range(places):
        order = np.argsort(own[:, k], kind="stable")
        value = own[order, k]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(value)) + 1, [n]])
        size = np.diff(edge) * (value[edge[:-1]] != 0)
        most = int(size.argmax())
        if size[most]:
            mask[order[edge[most] : edge[most + 1]]] |= np.int32(1 << k)
            size[most] = 0
        count[order, k] = np.repeat(size, np.diff(edge))
        orders.append(order)
        edges.append(edge)
    parts, sizes = [], []
    for k, (order, edge) in enumerate(zip(orders, edges, strict=True)):
        begin = edge[:-1]
        size = count[order[begin], k]
        keep = size > 1
        for beside in (k - 1, k + 1):
            if 0 <= beside < places:
                value = own[order, beside]
                same = np.minimum.reduceat(value, begin) == np.maximum.reduceat(value, begin)
                other = count[order[begin], beside]
                keep &= ~(same & ((other > size) | ((other == size) & (beside < k))))
        if keep.any():
            parts.append(rows[order[np.repeat(keep, np.diff(edge))]])
            sizes.append(size[keep])
    return mask, parts, np.concatenate([np.empty(0, np.int64), *sizes])


def _by_mask(mask: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows sorted by document, as _compared's, where two rows agree in what both of their masks have."""
    every, first = np.unique(mask, return_index=True)
    order = np.argsort(first)
    every, first = every[order], first[order]
    known = np.searchsorted(doc[first], doc)  # so many masks are of earlier documents
    by_mask = np.argsort(mask, kind="stable")
    begin = np.searchsorted(mask[by_mask], every)
    end = np.searchsorted(mask[by_mask], every, "right")
    rows, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n, own in enumerate(every):
        mine = by_mask[begin[n] : end[n]]
        both, at = np.unique(every[: known[mine[-1]]] & own, return_index=True)
        both, at = both[both != 0], at[both != 0]
        # Each is one of the widest from its first row on, until a row has more.
        until = np.full(len(both), len(every))
        for low in range(0, len(both), step := max(1, AT_ONCE // max(len(both), 1))):
            less = both[low : low + step, None]
            until[low : low + step] = np.where((less & ~both == 0) & (less != both), at, len(every)).min(1, initial=len(every))
        a, b = np.searchsorted(known[mine], at, "right"), np.searchsorted(known[mine], until, "right")
        size = np.maximum(b - a, 0)
        rows.append(mine[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())])
        others.append(first[np.repeat(at, size)])
    return np.concatenate(rows), np.concatenate(others)


def _linked(near: np.ndarray, doc: np.ndarray, groups: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of windows of one group, j's document before i's: the first j of each set of contexts in which i agrees with a j,
    but for sets within others and contexts that all of the group have. So for each stretch around i the earliest window that has it all.

    What this gives is what comparing all windows of a group gives. Windows alike in all that others of the group have are
    compared once. Those of a group of more than GROUP have, in each context, its most frequent value or another one: pairs that
    agree in frequent values alone are found by the masks of these, the others within the windows of each other value, where
    these leave half of the comparisons at most."""
    if not groups:
        return
    rows, group = np.concatenate(groups), np.repeat(np.arange(len(groups)), [len(x) for x in groups])
    own, doc = _shared(near[rows], group), doc[rows]
    some = np.flatnonzero(own.any(1))
    rows, group, own, doc = rows[some], group[some], own[some], doc[some]
    # Of a class the first window and the first one of a later document, which all others of these are linked as.
    first = _first(_classes(group, own))
    later = np.flatnonzero(doc != doc[first])
    first[later] = later[_first(first[later])]
    alone = np.flatnonzero(first == np.arange(len(rows)))
    edges = np.flatnonzero(np.concatenate([[True], np.diff(group[alone]) != 0, [True]])) if len(alone) else np.zeros(1, int)
    sizes = np.diff(edges)
    pairs, wide = [(np.empty(0, np.int64), np.empty(0, np.int64))], []
    for at in np.flatnonzero(sizes > GROUP):
        mine = alone[edges[at] : edges[at + 1]]
        mask, parts, counts = _split(own, mine)
        if 2 * int((counts**2).sum()) > len(mine) ** 2:
            pairs += _compared(own, doc, mine[None])
            continue
        i, j = _by_mask(mask, doc[mine])
        wide.append((mine[i], mine[j]))
        if parts:
            parts = np.concatenate(parts)
            begin = np.cumsum(counts) - counts
            wide.append((parts, np.repeat(parts[begin], counts)))
            wide += _linked(own, doc, np.split(parts, begin[1:]))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= GROUP)]):
        pairs += _compared(own, doc, alone[edges[:-1][sizes == size][:, None] + np.arange(size)])
    if wide:
        i, j = (np.concatenate(x) for x in zip(*wide, strict=True))
        both = np.unique((i * len(rows) + j)[doc[i] != doc[j]])
        i, j = both // len(rows), both % len(rows)
        pairs.append(_widest(i, j, _agree(own, i, j)))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    begin = np.searchsorted(i, first)
    size = np.searchsorted(i, first, "right") - begin
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    yield rows[np.repeat(np.arange(len(rows)), size)], rows[j[at]]


def _star(v: np.ndarray, near: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of windows with one value, i's document after j's; rows are sorted by document and place.

    j is the first window of the class, of the value, and, for the first of a class, those of _linked. So two documents that
    agree beyond a phrase which many others have meet, whichever part of their passage others have, too."""
    every = np.arange(len(v))
    first = _first(_classes(v, near))
    i, j = [every, every], [_first(v), first]
    firsts = np.flatnonzero(first == every)
    # Where a value has two classes at most, the links above are all.
    firsts = firsts[np.argsort(v[firsts], kind="stable")]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(v[firsts]) != 0, [True]])) if len(firsts) else np.zeros(1, int)
    groups = [firsts[edges[k] : edges[k + 1]] for k in np.flatnonzero(np.diff(edges) > 2)]
    for a, b in _linked(near, doc, groups):
        i.append(a)
        j.append(b)
    i, j = np.concatenate(i), np.concatenate(j)
    pick = doc[i] != doc[j]
    both = np.unique(i[pick].astype(np.int64) * len(v) + j[pick])
    return both // max(len(v), 1), both % max(len(v), 1)


def _batch(**columns) -> pa.RecordBatch:  # noqa: ANN003
    """Columns of HITS, null where not given, then ctx."""
    n = len(columns["v"])
    types = {"kind": pa.int8(), "x": pa.int64(), "y": pa.int64(), "v": pa.int64(), "ctx": pa.binary()}
    names = [*(x.split()[0] for x in HITS.split(", ")), "ctx"]
    arrays = [columns.get(c) for c in names]
    arrays = [pa.nulls(n, types.get(c, pa.int32())) if x is None else x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x), types.get(c, pa.int32())) for c, x in zip(names, arrays, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _packed(near: np.ndarray) -> pa.Array:
    """The contexts of each window as one value."""
    data = np.ascontiguousarray(near, "<u2")
    ends = np.arange(len(data) + 1, dtype=np.int32) * (2 * len(PLACES))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _unpacked(ctx: pa.Array) -> np.ndarray:
    begin = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset] if len(ctx) else 0
    return np.frombuffer(ctx.buffers()[2], "<u2", len(ctx) * len(PLACES), begin).reshape(len(ctx), len(PLACES)) if len(ctx) else np.empty((0, len(PLACES)), "<u2")


def near_passages(docs: DataFrame, scratch: Scratch, *, size: int = 5, percent: int = 80, words: int = 50, hashes: int = 4, enough: int = 2, known: int = 1 << 22) -> DataFrame:
    """doc_id, start, end, of_doc_id, of_start, of_end, shared, jaccard: passages that an earlier document has too.

    start and end are positions of words, end excluded; a passage has `words` words or more, and its set
    of shingles of `size` words (A-Z lower-cased) has a Jaccard similarity of percent / 100 or more with that of the passage in
    of_doc_id, a document with a smaller id.

    For each of `hashes` hash functions a text's shingles give compact windows of words - size + 1 or more shingles. Windows
    that share a minimum hash are joined to the first document that has it, to the first one that has all contexts, too (its
    class), and to the first one of each widest set of contexts they agree in. So a passage in very many documents costs each of
    them a few rows, and is reported with some of these, not all. A task passes on the contexts of one window of a class alone;
    the others are joined to the first one of their class afterwards, so the result does not depend on how rows are dealt out.
    A pair of documents goes on where windows of `enough` hash functions overlap, or those of one agree in STRONG contexts; there
    the shingles of both are compared, and the longest stretches with percent of them shared are cut out. What none of the
    functions has in common, and agreement that is only within the shingles of one context, may be missed.

    Texts of fewer words, null texts and rows with a null doc_id have no passages; rows with equal ids
    count as one document, of which one text is compared. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    set_batches(spark)
    least = words - size + 1
    seeds = [U(0x9E3779B97F4A7C15 * (2 * i + 3) % 2**64) for i in range(hashes)]
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def shingles(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for part in W.split(W.column_of(batch, "text"), lower=True):
            own, begins = W.shingles(part, size, whole=False)
            for i in range(len(part)):
                yield part.first + i, own[begins[i] : begins[i + 1]]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first window of each class with its contexts (kind 1 if it has others behind it), and the others (kind 2)."""
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            v, near, doc, spans = (np.concatenate([x[k] for x in held]) for k in range(4))
            whole = _classes(v, near)
            order = np.lexsort((spans[:, 0], doc, whole))
            new = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
            more = np.zeros(len(v), np.int8)
            more[order[new]] = np.diff(np.concatenate([np.flatnonzero(new), [len(v)]])) > 1
            k, rest = order[new], order[~new]
            first = _batch(kind=more[k], x=doc[k], **dict(zip(("xl", "xc", "xr"), spans[k].T, strict=True)), v=v[k], ctx=_packed(near[k]))
            # The function's number, in the value's last bits, moves on into the class.
            other = _batch(kind=np.full(len(rest), 2, np.int8), x=doc[rest], **dict(zip(("xl", "xc", "xr"), spans[rest].T, strict=True)), v=whole_of(v[rest], whole[rest]))
            return pa.Table.from_batches([first, other]).combine_chunks().to_batches()

        total = 0
        for batch in batches:
            ids = W.column_of(batch, "doc_id").to_pylist()
            for row, own in shingles(batch):
                if len(own) < least:
                    continue
                beside = _contexts(own)
                for k, seed in enumerate(seeds):
                    values = W.mix(own ^ seed)
                    spans = np.array(compact_windows(values, least), np.int32)
                    c = spans[:, 1]
                    v = ((values[c] & ~U(15)) | U(k)).view(np.int64)
                    held.append((v, beside[c[:, None] + np.array(PLACES) + REACH], np.full(len(c), ids[row], np.int64), spans))
                    total += len(c)
            if total >= HELD:
                yield from flush()
                held, total = [], 0
        if held:
            yield from flush()

    def whole_of(v: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return ((whole & ~U(15)) | (v.view(U) & U(15))).view(np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by value: hits among the windows of each value, the first windows of classes with others, and these as they are."""
        held: list[pa.RecordBatch] = []
        names = [x.split()[0] for x in HITS.split(", ")]

        def join(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            v, doc, kind = (W.column_of(rows, c).to_numpy() for c in ("v", "x", "kind"))
            spans = np.column_stack([W.column_of(rows, c).to_numpy() for c in ("xl", "xc", "xr")])
            near = _unpacked(W.column_of(rows, "ctx").combine_chunks())
            order = np.lexsort((spans[:, 0], doc))
            v, doc, kind, spans, near = v[order], doc[order], kind[order], spans[order], near[order]
            i, j = _star(v, near, doc)
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                strong = ((near[a] == near[b]) & (near[a] != 0)).sum(1) >= STRONG
                yield _batch(kind=np.zeros(len(a), np.int8), x=doc[a], y=doc[b], **dict(zip(("xl", "xc", "xr"), spans[a].T, strict=True)), **dict(zip(("yl", "yc", "yr"), spans[b].T, strict=True)), v=v[a] | (strong * 8)).select(names)
            whole = _classes(v, near)
            first = _first(whole)
            k = np.unique(first[kind == 1])
            if len(k):
                yield _batch(kind=np.ones(len(k), np.int8), y=doc[k], **dict(zip(("yl", "yc", "yr"), spans[k].T, strict=True)), v=whole_of(v[k], whole[k])).select(names)

        total = 0
        for batch in batches:
            alone = pc.equal(W.column_of(batch, "kind"), 2)
            own = batch.filter(alone).select(names)
            if len(own):
                yield own
            own = batch.filter(pc.invert(alone))
            if not len(own):
                continue
            held.append(own)
            total += len(own)
            if total >= HELD:
                rows = pa.Table.from_batches(held)
                v = W.column_of(rows, "v").to_numpy()
                cut = int(np.searchsorted(v, v[-1]))  # the last value may go on
                if cut:
                    yield from join(rows.slice(0, cut))
                    held, total = rows.slice(cut).combine_chunks().to_batches(), len(v) - cut
        if held:
            yield from join(pa.Table.from_batches(held))

    made = read.mapInArrow(windows, f"{HITS}, ctx binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    # Windows without contexts only pass through, dealt out by document.
    dealt = made.repartition(parts, F.when(F.col("kind") == 2, F.col("x")).otherwise(F.col("v"))).sortWithinPartitions("v")
    met = scratch.save(dealt.mapInArrow(meet, HITS), "met")
    heads = met.where("kind = 1").select("v", "y", "yl", "yc", "yr")
    others = met.where("kind = 2").select("x", "xl", "xc", "xr", "v").join(heads, "v").where("x != y").withColumn("v", F.col("v").bitwiseOR(F.lit(8)))
    both = met.where("kind = 0").select("x", "y", "xl", "xc", "xr", "yl", "yc", "yr", "v").unionByName(others)
    hit = F.struct("xl", "xc", "xr", "yl", "yc", "yr", F.col("v").bitwiseAND(F.lit(15)).cast("int").alias("k"))
    pairs = both.groupBy("x", "y").agg(F.collect_list(hit).alias("hits"))
    pairs = pairs.where((F.array_max("hits.k") >= 8) | (F.size(F.array_distinct("hits.k")) >= enough))
    pairs = scratch.save(pairs, "pairs")
    scratch.drop("met")
    needed = scratch.save(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "needed")
    if needed.count() <= known:
        ids = spark.sparkContext.broadcast(np.sort(needed.toArrow()["id"].to_numpy()))
    else:
        read, ids = read.join(needed, read.doc_id == needed.id, "left_semi"), None

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if ids is not None:
                batch = batch.filter(pa.array(np.isin(W.column_of(batch, "doc_id").to_numpy(), ids.value)))
            if len(batch):
                own = [(i, (x >> U(32)).astype("<u4").tobytes()) for i, x in shingles(batch)]
                yield pa.RecordBatch.from_arrays([W.column_of(batch, "doc_id").take([i for i, _ in own]), W.binary([x for _, x in own])], names=["id", "values"])

    sets = scratch.save(read.mapInArrow(again, "id long, values binary").groupBy("id").agg(F.max("values").alias("values")), "sets")
    # A document may be y of very many pairs, but x of few: what carries sets is dealt out by x.
    joined = pairs.join(sets.select(F.col("id").alias("y"), F.col("values").alias("ys")), "y").join(sets.select(F.col("id").alias("x"), F.col("values").alias("xs")), "x")
    return joined.mapInArrow(_verify(least, size, percent, enough), "doc_id long, start int, end int, of_doc_id long, of_start int, of_end int, shared int, jaccard double")


def runs(shared: np.ndarray, least: int, percent: int) -> Iterator[tuple[int, int]]:
    """The longest stretch of which enough are shared for the similarity, then those on both sides of it."""
    gain = np.where(shared, 100 - percent, -2 * percent)
    rest = [(0, len(shared))]
    while rest:
        low, high = rest.pop()
        if high - low < least:
            continue
        sums = np.concatenate([[0], np.cumsum(gain[low:high])])
        # From each start the furthest end whose sum is not below the start's.
        top = np.maximum.accumulate(sums[::-1])
        ends = len(sums) - 1 - np.searchsorted(top, sums)
        i = int((ends - np.arange(len(sums))).argmax())
        some = np.flatnonzero(shared[low + i : low + int(ends[i])])
        if not len(some):
            continue
        a, b = low + i + int(some[0]), low + i + int(some[-1]) + 1
        if b - a < least:
            continue
        yield a, b
        rest += [(low, a), (b, high)]


def _verify(least: int, size: int, percent: int, enough: int):  # noqa: ANN202
    def regions(hits: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Overlapping windows of both documents, by their diagonal, that `enough` hash functions gave, or one with STRONG contexts."""
        diagonal = (hits[:, 1] - hits[:, 4]) // 16
        order = np.lexsort((hits[:, 0], diagonal))
        rows = np.column_stack([diagonal, hits[:, [0, 2, 3, 5, 6]]])[order].tolist()
        k = 0
        while k < len(rows):
            near, xl, xr, yl, yr, _ = rows[k]
            kinds, strong = set(), False
            while k < len(rows) and rows[k][0] - near <= 1 and rows[k][1] <= xr:
                near, l, r, l2, r2, kind = rows[k]
                xl, xr, yl, yr = min(xl, l), max(xr, r), min(yl, l2), max(yr, r2)  # the next diagonal's windows may begin earlier
                kinds.add(kind & 7)
                strong |= kind >= 8
                k += 1
            if strong or len(kinds) >= enough:
                yield xl, xr + 1, yl, yr + 1

    def match(mine: np.ndarray, other: np.ndarray, places: np.ndarray, shared: np.ndarray) -> tuple[int, int, int, float]:
        """(shared, low, high, Jaccard): the better of the span of all places and the one on their median diagonal."""
        own, best = np.unique(mine), (0, 0, 0, 0.0)
        found = places[shared]
        start = int(np.median(found - np.flatnonzero(shared)))
        for low, high in ((int(found.min()), int(found.max()) + 1), (max(start, 0), min(start + len(mine), len(other)))):
            their = np.unique(other[low:high])
            both = int(np.isin(own, their, assume_unique=True).sum())
            alike = both / max(len(own) + len(their) - both, 1)
            if alike > best[3]:
                best = both, low, high, alike
        return best

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            every = W.column_of(batch, "hits")
            begins, every = every.offsets.to_numpy(), every.values
            every = np.column_stack([every.field(k).to_numpy() for k in range(7)])
            for n, (x, y, xs, ys) in enumerate(zip(*(W.column_of(batch, c).to_pylist() for c in ("x", "y", "xs", "ys")), strict=True)):
                hits = every[begins[n] : begins[n + 1]]
                xs, ys = np.frombuffer(xs, "<u4"), np.frombuffer(ys, "<u4")
                done: list[tuple[int, int]] = []
                for a, b, c, d in regions(hits):
                    if any(p <= a and b <= q for p, q in done):
                        continue
                    own = ys[c:d]
                    order = np.argsort(own, kind="stable")
                    at = np.minimum(np.searchsorted(own[order], xs[a:b]), len(own) - 1)
                    shared = own[order][at] == xs[a:b]
                    # Runs, and the stretches without a gap, as a run may fail or end within one.
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], shared, [False]]).astype(np.int8)))
                    for i, j in [*runs(shared, least, percent), *((int(p), int(q)) for p, q in edges.reshape(-1, 2))]:
                        if j - i < least or any(p <= a + i and a + j <= q for p, q in done):
                            continue
                        both, low, high, alike = match(xs[a + i : a + j], own, order[at[i:j]], shared[i:j])
                        if 100 * alike >= percent:
                            done.append((a + i, a + j))
                            out.append((x, a + i, a + j + size - 1, y, c + low, c + high + size - 1, both, alike))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "of_doc_id", "of_start", "of_end", "shared", "jaccard"])

    return check


def drop_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs without the words of their passages, which stay in the earlier document; n_words_dropped is added."""
    own = passages.groupBy(F.col("doc_id").alias("siltbed_id")).agg(F.collect_set(F.struct("start", "end")).alias("siltbed_spans"))
    read = docs.join(own, docs.doc_id == own.siltbed_id, "left").drop("siltbed_id")
    rest = [c for c in docs.columns if c != "n_words_dropped"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = W.column_of(batch, "text").to_pylist(), [0] * len(batch)
            spans = W.column_of(batch, "siltbed_spans").to_pylist()
            for part in W.split(W.column_of(batch, "text"), lower=True):
                for i in range(len(part)):
                    row = part.first + i
                    if not spans[row]:
                        continue
                    begin, starts = part.rows[i], part.starts
                    keep = np.ones(part.rows[i + 1] - begin, bool)
                    for s in spans[row]:
                        keep[s["start"] : s["end"]] = False
                    data = part.data[part.bounds[i] : part.bounds[i + 1]].copy()
                    mask = np.ones(len(data), bool)
                    edges = np.concatenate([starts[begin : part.rows[i + 1]] - part.bounds[i], [len(data)]])
                    for k in np.flatnonzero(~keep):
                        mask[edges[k] : edges[k + 1]] = False
                    texts[row], gone[row] = data[mask].tobytes().decode(), int((~keep).sum())
            columns = [pa.array(texts, pa.string()) if c == "text" else W.column_of(batch, c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=[*rest, "n_words_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema) + ", n_words_dropped long"
    return read.mapInArrow(cut, schema)

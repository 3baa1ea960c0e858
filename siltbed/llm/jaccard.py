"""Grouped prefix join: documents whose sets of word shingles reach a Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .links import components
from .scratch import Scratch, set_batches

U = np.uint64
PARTS = 64
#: Odd factors; the smallest product of a set's shingles with each is its sketch.
SKETCH = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Shingles that the sets of a cell have together, about.
CELL = 1 << 20
#: Hashes of shingles that a task counts at once, 8 bytes each.
COUNTED = 1 << 21
#: Rows of lists of leaders that a task holds at once.
LISTED = 1 << 16


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of a batch's texts, A-Z lower-cased."""
    for part in W.split(W.column_of(batch, "text"), lower=True):
        hashes, begins = W.shingles(part, size, whole=True)
        for i in range(len(part)):
            own = np.sort(hashes[begins[i] : begins[i + 1]])
            yield part.first + i, own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _first(n: int, percent: int) -> int:
    """Shingles of a prefix: two sets that link share one within their prefixes."""
    return n - -(-percent * n // 100) + 1


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and how often they occur in all parts, 2^32 - 1 at most."""
    keys = np.concatenate([x for x, _ in held])
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], np.concatenate([x for _, x in held])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sums = np.add.reduceat(times, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
    return keys[first], np.minimum(sums, 2**32 - 1).astype(np.uint32)


def _count(over: int, most: int = COUNTED):  # noqa: ANN202
    """Rows (part, keys, times) sorted by part: (key, n) of the keys that occur more than `over` times."""

    def result(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, times = _counted(held)
        often = np.flatnonzero(times > over)
        for i in range(0, len(often), 1 << 16):
            own = often[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[own].astype(np.int64)), pa.array(times[own].astype(np.int64))], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, [], 0
        for batch in batches:
            for part, keys, times in zip(*(W.column_of(batch, c).to_pylist() for c in ("part", "keys", "times")), strict=True):
                if part != now:
                    if held:
                        yield from result(held)
                    now, held, total = part, [], 0
                held.append((np.frombuffer(keys, np.uint32), np.frombuffer(times, np.uint32)))
                total += len(held[-1][0])
                if total >= most + len(held[0][0]):
                    held = [_counted(held)]
                    total = len(held[0][0])
        if held:
            yield from result(held)

    return run


def _pair_up(percent: int, over: int, chunk: int = LISTED):  # noqa: ANN202
    """Rows (s, gid, n) sorted so: pairs (kind 0) of leaders that share a shingle and may link by size.

    A list longer than 4 * over comes out as it is: shingle and leader (kind 1). Lists are read `chunk` rows at a time."""
    names = ["a", "b", "kind"]

    def out(a: np.ndarray, b: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 1 << 16):
            own = a[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(b[i : i + (1 << 16)]), pa.array(np.full(len(own), kind, np.int8))], names=names)

    def lists(s: np.ndarray, gid: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole lists."""
        if not len(s):
            return
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        length = np.diff(np.concatenate([begin, [len(s)]]))
        first = np.repeat(begin, length)
        long = np.repeat(length > 4 * over, length)
        yield from out(s[long], gid[long], 1)
        a, b = [gid[:0]], [gid[:0]]
        for step in range(1, int(min(length.max(), 4 * over))):
            i = np.flatnonzero((first[step:] == first[:-step]) & ~long[step:])
            i = i[100 * n[i].astype(np.int64) >= percent * n[i + step].astype(np.int64)]
            a.append(gid[i])
            b.append(gid[i + step])
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
        yield from out(a[keep], b[keep], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, going = [], 0, None  # going: the shingle of a long list whose rows so far are out

        def read(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, going
            s, gid, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            known = int(np.searchsorted(s, going, "right")) if going is not None else 0
            yield from out(s[:known], gid[:known], 1)
            s, gid, n = s[known:], gid[known:], n[known:]
            cut = len(s) if last or not len(s) else int(np.searchsorted(s, s[-1]))  # the last list may go on
            yield from lists(s[:cut], gid[:cut], n[:cut])
            s, gid, n = s[cut:], gid[cut:], n[cut:]
            if len(s) > 4 * over:
                going = s[0]
                yield from out(s, gid, 1)
                s, gid, n = s[:0], gid[:0], n[:0]
            held = [(s, gid, n)]

        for batch in batches:
            held.append(tuple(W.column_of(batch, c).to_numpy() for c in ("s", "gid", "n")))
            total += len(batch)
            if total >= chunk:
                yield from read(False)
                total = len(held[0][0])
        if held:
            yield from read(True)

    return run


def frequent(docs: DataFrame, scratch: Scratch, size: int, over: int, share: float, most: int) -> np.ndarray:
    """Upper halves, sorted, of shingles that occur among the first `share` of over `over` documents.

    The set only fixes the order of shingles, so the join is right with any set; at most `most`, those
    above some frequency, are taken, 4 bytes each, which bounds what is sent to the executors.
    Keys are counted before they are dealt out, so one of very many documents is few entries, and a task
    adds up COUNTED entries at a time: it holds those and the different keys of its range, of 32 bits, alone.
    """
    session = docs.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 8)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(1, n) * int(share * 1.2 * 2**32 / n)

        def flush() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            times = times.astype(np.uint32)
            cut = np.searchsorted(keys, bounds)
            return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), *(W.binary([x.tobytes() for x in np.split(y, cut)]) for y in (keys, times))], names=["part", "keys", "times"])

        held, total = [], 0
        for batch in batches:
            for _, own in _sets(batch, size):
                held.append((own[: int(len(own) * share) + 2] >> U(32)).astype(np.uint32))
                total += len(held[-1])
            if total >= COUNTED:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    dealt = docs.mapInArrow(W.lean(emit), "part int, keys binary, times binary").where("length(keys) > 0").repartition(n, "part").sortWithinPartitions("part")
    rows = scratch.save(dealt.mapInArrow(W.lean(_count(over)), "key long, n long"), "frequent")
    level = F.floor(F.log2("n") * 64).cast("int")
    counts = rows.groupBy(level.alias("level")).count().collect()  # a few hundred rows
    least, total = 0, 0
    for level_, n_ in sorted(((r["level"], r["count"]) for r in counts), reverse=True):
        total += n_
        if total > most:
            least = level_ + 1
            break
    return np.sort(rows.where(level >= least).select("key").toArrow()["key"].to_numpy().astype(np.uint32))


def _bar(n: np.ndarray | int, m: np.ndarray | int, percent: int):  # noqa: ANN202
    """The largest symmetric difference of sets of n and m that link."""
    return (n + m) * (100 - percent) // (100 + percent)


def similar_documents(docs: DataFrame, scratch: Scratch, *, size: int = 5, percent: int = 80, over: int = 16, cell: int = 256, known: int = 1 << 22, most: int = 1 << 22) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): documents linked by shingle sets, percent or more alike.

    1. Shingles are ordered by (frequent, hash), see frequent(). A set's prefix is its first
       n - ceil(percent n / 100) + 1 shingles; sets that link share one within their prefixes.
    2. Documents with one size and prefix form a group; only a group's leader is joined.
    3. Leaders that share a prefix shingle that isn't frequent are candidate pairs, if sizes allow. A shingle of
       more than 4 * over leaders makes no pairs but a list, and so do frequent prefix shingles and groups of over `over` sets.
    4. Pairs whose counts of shingles by 64 parts differ too much can't link and go; the others are verified on
       whole sets, which are made anew for just those documents.
    5. Sets of lists that agree in a minimum hash meet in cells of `cell` sets at most (fewer, if sets are large), which return
       a spanning forest of their links: a row for each set and hash, so copies of a text with very many variants cost linear work.
    6. What a list has in one component by then needs no further pair. Lists that have several are joined to
       pools; a pool's sets outside of its largest component meet each other and that one in cells of one size band and
       the next, and pairs of different components that the counts allow are verified. So no link is lost.

    Rows without words have 0 shingles, link with nothing and are their own component; so are rows
    with a null doc_id (component null). Rows with equal ids are one node. n_links counts the verified
    links kept for the component, not all pairs. Columns other than doc_id and text are not read.
    """
    set_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast(frequent(docs, scratch, size, over, 0.3, most))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = spread.value
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for _, own in _sets(batch, size):
                n = len(own)
                top = (own >> U(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(often, top), max(len(often) - 1, 0))
                hot = often[at] == top if len(often) else np.zeros(n, bool)
                m = _first(n, percent) if n else 0
                rare = own[~hot][:m]
                rest = own[hot][: m - len(rare)]
                counts = np.minimum(np.bincount((own & U(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8)
                key = W.signature(rare) + W.signature(rest) if n else b""
                sketch = [int((own * x).min().view(np.int64)) for x in SKETCH] if n else []
                for values, x in zip(out, (n, W.signature(own), counts.tobytes(), key, rare.tobytes(), rest.tobytes(), sketch), strict=True):
                    values.append(x)
            yield pa.RecordBatch.from_arrays([W.column_of(batch, "doc_id"), pa.array(out[0], pa.int64()), *(W.binary(x) for x in out[1:6]), pa.array(out[6], pa.list_(pa.int64()))], names=names)

    names = ["doc_id", "n", "sig", "parts", "key", "rare", "often", "sketch"]
    base = scratch.save(docs.mapInArrow(W.lean(prefixes), "doc_id long, n long, sig binary, parts binary, key binary, rare binary, often binary, sketch array<long>"), "base")
    full = base.where("n > 0 and doc_id is not null")
    # Members: the different sets of each group, by their smallest document.
    members = full.groupBy("n", "key", "sig").agg(F.min("doc_id").alias("rep"))
    groups = members.groupBy("n", "key").agg(F.min("rep").alias("gid"), F.count("*").alias("sets"))
    members = scratch.save(members.join(groups, ["n", "key"]).select("n", "key", "sig", "rep", "gid", "sets"), "members")
    heads = members.where("rep = gid").select(F.col("rep").alias("doc_id"), "n", "sig", "sets")
    leaders = scratch.save(full.select("doc_id", "n", "sig", "rare", "often").join(heads, ["doc_id", "n", "sig"]).dropDuplicates(["doc_id", "n", "sig"]).select(F.col("doc_id").alias("gid"), "n", "rare", "often", "sets"), "leaders")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids, sizes = W.column_of(batch, "gid").to_numpy(), W.column_of(batch, "n").to_numpy()
            rare = [np.frombuffer(x, np.int64) for x in W.column_of(batch, "rare").to_pylist()]
            each = [len(x) for x in rare]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare) if rare else [], pa.int64()), pa.array(np.repeat(gids, each)), pa.array(np.repeat(sizes, each).astype(np.int32))], names=["s", "gid", "n"])

    listed = leaders.select("gid", "n", "rare").mapInArrow(W.lean(entries), "s long, gid long, n int").repartition("s").sortWithinPartitions("s", "n", "gid")
    found = scratch.save(listed.mapInArrow(W.lean(_pair_up(percent, over)), "a long, b long, kind byte"), "found")
    # Candidate pairs of groups, and pairs inside small groups, as pairs of members with a filter on counts.
    who = members.select("gid", "rep", "n", "sig", "sets")
    sides = base.select("doc_id", "sig", "parts", "sketch").dropDuplicates(["doc_id", "sig"])
    who = who.join(sides.withColumnRenamed("doc_id", "rep"), ["rep", "sig"]).select("gid", "rep", "n", "parts", "sketch", "sets")
    who = scratch.save(who, "who")
    left = who.select(F.col("gid").alias("a"), F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("parts").alias("xp"))
    right = who.select(F.col("gid").alias("b"), F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("parts").alias("yp"))
    small = who.where(f"sets > 1 and sets <= {over}")
    inside = small.select(F.col("gid").alias("a"), F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("parts").alias("xp"))
    inside = inside.join(small.select(F.col("gid").alias("a"), F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("parts").alias("yp")), "a").where("x < y").drop("a")
    across = found.where("kind = 0 and a != b").select("a", "b").distinct().join(left, "a").join(right, "b").select("x", "xn", "xp", "y", "yn", "yp")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            xp, yp = (np.frombuffer(b"".join(W.column_of(batch, c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for c in ("xp", "yp"))
            xn, yn = (W.column_of(batch, c).to_numpy() for c in ("xn", "yn"))
            fits = np.abs(xp - yp).sum(axis=1) <= _bar(xn, yn, percent)
            yield pa.RecordBatch.from_arrays([pa.array(W.column_of(batch, c).to_numpy()[fits]) for c in ("x", "y")], names=["x", "y"])

    pairs = scratch.save(inside.unionByName(across).mapInArrow(W.lean(sieve), "x long, y long"), "pairs")
    # Lists: long ones of shingles, large groups, and frequent shingles.

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, np.int64) for x in W.column_of(batch, "often").to_pylist()]
            gids = np.repeat(W.column_of(batch, "gid").to_numpy(), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(gids, pa.int64())], names=["s", "gid"])

    lists = found.where("kind = 1").select(F.col("a").alias("s"), F.col("b").alias("gid"))
    lists = lists.union(leaders.where("length(often) > 0").select("gid", "often").mapInArrow(W.lean(spelled), "s long, gid long"))
    lists = scratch.save(lists.union(members.where(f"rep = gid and sets > {over}").select(F.xxhash64(F.lit("group"), "gid"), "gid")).distinct(), "lists")
    scratch.drop("found", "leaders", "frequent")
    listed = scratch.save(who.join(lists.select("gid").distinct(), "gid", "left_semi").select("gid", "rep", "n", "parts", "sketch"), "listed")
    scratch.drop("who")
    near = listed.select("rep", "n", F.posexplode("sketch").alias("k", "value"))
    # The key is written as a sum, so that the large side is dealt out anew and hot keys can be split.
    common = near.groupBy("k", "value").agg(F.count("*").alias("sets"), F.sum("n").alias("all")).where("sets > 1")
    common = common.select("k", (F.col("value") + F.lit(0)).alias("value"), F.greatest(F.ceil(F.col("sets") / cell), F.ceil(F.col("all") / CELL)).alias("cells"))
    cells = F.concat_ws(":", "k", "value", F.pmod(F.xxhash64("rep", "k"), F.col("cells")).cast("string"))
    near = scratch.save(near.join(common, ["k", "value"]).select(cells.alias("cell"), "rep"), "near")
    needed = scratch.save(pairs.select("x").union(pairs.select("y")).union(listed.select("rep")).toDF("id").distinct(), "needed")
    sets = scratch.save(_whole_sets(docs, needed, size, known), "sets")
    verified = _verify_pairs(pairs, sets, percent)
    verified = verified.union(near.join(sets, near.rep == sets.id).select("cell", "rep", "values").repartition("cell").sortWithinPartitions("cell").mapInArrow(W.lean(_verify_cells(percent)), "a long, b long"))
    verified = scratch.save(verified.distinct(), "links")
    scratch.drop("near", "needed", "pairs")
    known_ = components(verified, scratch, "near")
    mixed = _mixed(lists, listed, known_, scratch, percent)
    if mixed is not None:
        meets = _meets(mixed, 4 * cell).join(listed.select("rep", "parts"), "rep")
        more = meets.repartition("cell").sortWithinPartitions("cell").mapInArrow(W.lean(_sieve_cells(percent)), "x long, y long").distinct()
        verified = scratch.save(verified.union(_verify_pairs(scratch.save(more, "more"), sets, percent)).distinct(), "all_links")
    scratch.drop("sets", "listed", "lists", "several", "mixed", "more")
    joined = members.select("n", "sig", "rep").where("n > 0")
    # A row's node is its id; rows of one id or one set are one node.
    ties = full.select("doc_id", "n", "sig").join(joined, ["n", "sig"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(verified.select("a", "b").union(ties), scratch, "docs")
    degree = verified.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    out = base.select("doc_id", F.col("n").alias("n_shingles")).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(degree.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    alone = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, alone).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _whole_sets(docs: DataFrame, needed: DataFrame, size: int, known: int) -> DataFrame:
    """(id, values) of the needed documents. Up to `known` ids are sent to the scan; more are joined."""
    count = needed.count()
    if count <= known:
        ids = docs.sparkSession.sparkContext.broadcast(np.sort(needed.toArrow()["id"].to_numpy()))
    else:
        docs, ids = docs.join(needed, docs.doc_id == needed.id, "left_semi"), None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if ids is not None:
                own = W.column_of(batch, "doc_id").to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(np.isin(own, ids.value)))
            if len(batch):
                found = [(i, x.tobytes()) for i, x in _sets(batch, size)]
                yield pa.RecordBatch.from_arrays([W.column_of(batch, "doc_id").take([i for i, _ in found]), W.binary([x for _, x in found])], names=["id", "values"])

    return docs.mapInArrow(W.lean(make), "id long, values binary").where("length(values) > 0").dropDuplicates(["id"])


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(W.column_of(batch, c).to_pylist() for c in ("x", "y", "xs", "ys")), strict=True):
                s, t = np.frombuffer(s, U), np.frombuffer(t, U)
                both = len(s) + len(t)
                merged = np.sort(np.concatenate([s, t]))
                shared = int((merged[1:] == merged[:-1]).sum())
                if 100 * shared >= percent * (both - shared):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    left = sets.select(F.col("id").alias("x"), F.col("values").alias("xs"))
    right = sets.select(F.col("id").alias("y"), F.col("values").alias("ys"))
    return pairs.distinct().join(left, "x").join(right, "y").mapInArrow(W.lean(check), "a long, b long")


def _by_cell(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """The rows of each cell, from batches sorted by cell."""
    now, held = None, []
    for batch in batches:
        for cell, *rest in zip(*(W.column_of(batch, c).to_pylist() for c in ("cell", *names)), strict=True):
            if cell != now:
                if held:
                    yield held
                now, held = cell, []
            held.append((cell, *rest))
    if held:
        yield held


def _mixed(lists: DataFrame, listed: DataFrame, known: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """pool, rep, n, comp, band, out of lists that have sets of several components; out: not of the pool's largest one.

    A pool is what such lists join, so that sets which share many of them meet once."""
    rows = lists.join(listed.select("gid", "rep", "n"), "gid").join(known.withColumnRenamed("node", "rep"), "rep", "left").select("s", "rep", "n", F.coalesce("root", "rep").alias("comp"))
    several = rows.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("rep").alias("first")).where("low != high").select((F.col("s") + F.lit(0)).alias("s"), "first")
    rows = scratch.save(rows.join(several, "s").select("rep", "n", "comp", "first").distinct(), "several")
    if rows.isEmpty():
        return None
    pool = components(rows.select(F.col("first").alias("a"), F.col("rep").alias("b")), scratch, "pool")
    rows = rows.select("rep", "n", "comp").distinct().join(pool.select(F.col("node").alias("rep"), F.col("root").alias("pool")), "rep")
    most = rows.groupBy("pool", "comp").agg(F.count("*").alias("sets")).groupBy("pool").agg(F.max(F.struct("sets", "comp")).alias("m")).select((F.col("pool") + F.lit(0)).alias("pool"), F.col("m.comp").alias("most"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")
    return scratch.save(rows.join(most, "pool").select("pool", "rep", "n", "comp", band.alias("band"), (F.col("comp") != F.col("most")).alias("out")), "mixed")


def _meets(mixed: DataFrame, cell: int) -> DataFrame:
    """cell, rep, n, comp, out: sets that are `out` meet those of their pool, of their band and the next ones, in cells of about 2 * cell."""
    count = lambda what: F.ceil(F.count(F.when(what, 1)) / cell).cast("int")
    bands = mixed.groupBy("pool", "band").agg(count(F.col("out")).alias("o"), count(~F.col("out")).alias("d"))
    beside = {"": 0, "_up": 1, "_down": -1}
    sizes = None
    for name, step in beside.items():
        own = bands.select((F.col("pool") + F.lit(0)).alias("pool"), (F.col("band") - step).alias("band"), *(F.col(c).alias(c + name) for c in ("o", "d")))
        sizes = own if sizes is None else sizes.join(own, ["pool", "band"], "left")
    sizes = sizes.fillna(0)
    rows = mixed.join(sizes, ["pool", "band"])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("out"), F.col("o")).otherwise(F.col("d")))).cast("int"))
    salt = F.col("salt")

    def grid(kind: str, band, n: str, first, second):  # noqa: ANN001, ANN202
        """The names of cells of `kind`, one for each of n salts on the other side."""
        steps = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda t: F.concat_ws(":", F.lit(kind), F.col("pool"), band, first(t), second(t)))

    band, mine, other = F.col("band"), lambda t: salt, lambda t: t
    outside = [
        grid("oo", band, "o", lambda t: F.least(t, salt), lambda t: F.greatest(t, salt)),
        grid("up", band, "o_up", mine, other),
        grid("up", band - 1, "o_down", other, mine),
        grid("od", band, "d", mine, other),
        grid("od_up", band, "d_up", mine, other),
        grid("od_down", band, "d_down", mine, other),
    ]
    inside = [grid("od", band, "o", other, mine), grid("od_up", band - 1, "o_down", other, mine), grid("od_down", band + 1, "o_up", other, mine)]
    names = F.when(F.col("out"), F.concat(*outside)).otherwise(F.concat(*inside))
    return rows.select(F.explode(names).alias("cell"), "rep", "n", "comp", "out")


def _sieve_cells(percent: int):  # noqa: ANN202
    """Rows (cell, rep, n, comp, out, parts) become pairs (x, y) of different components, one of them out, that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches, ["rep", "n", "comp", "out", "parts"]):
            rep, n, comp = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            counts = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, PARTS).astype(np.int16)
            for i in np.flatnonzero([r[4] for r in rows]):
                some = np.flatnonzero(comp != comp[i])
                some = some[np.abs(counts[some] - counts[i]).sum(axis=1) <= _bar(n[some], n[i], percent)]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[some], rep[i])), pa.array(np.maximum(rep[some], rep[i]))], names=["x", "y"])

    return run


def _verify_cells(percent: int):  # noqa: ANN202
    """Rows (cell, rep, values) sorted by cell become a spanning forest of each cell's links."""

    def flush(ids: list[int], sets: list[bytes]) -> tuple[list[int], list[int]]:
        own = [np.frombuffer(x, U) for x in sets]
        sizes = np.array([len(x) for x in own], np.int64)
        values, where, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = np.zeros((len(own), len(own)), np.float32)
        column = np.cumsum(times > 1) - 1
        row = np.repeat(np.arange(len(own)), sizes)
        common = times[where] > 1
        row, column = row[common], column[where[common]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        wide = 1 << 13
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            i, j = np.searchsorted(column, [low, low + wide])
            block = np.zeros((len(own), wide), np.float32)
            block[row[i:j], column[i:j] - low] = 1
            shared += block @ block.T
        shared = np.rint(shared).astype(np.int64)
        linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        a, b, left = [], [], np.ones(len(own), bool)
        for i in range(len(own)):
            if left[i]:
                left[i] = False
                front = [i]
                while front:
                    k = front.pop()
                    for m in np.flatnonzero(linked[k] & left):
                        left[m] = False
                        front.append(int(m))
                        a.append(ids[k])
                        b.append(ids[m])
        return a, b

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches, ["rep", "values"]):
            if len(rows) > 1:
                a, b = flush([r[1] for r in rows], [r[2] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return check

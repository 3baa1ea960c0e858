"""Words of whole texts as arrays: split at ASCII white space and hashed, a batch at a time.

A word is `[^\\x20\\x09-\\x0D]+`. Its hash is a polynomial over its bytes with random 64-bit
coefficients, mixed; it depends on the word alone, so it is the same in every task and run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C13  # 3 modulo 8
_BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**64 - 1, 256, dtype=U)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Bytes of text that are split at once; a longer text is split alone.
CHUNK = 1 << 20
#: What a worker keeps from task to task, for one operator.
_kept: dict[str, object] = {}
#: glibc's; other C libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        for i, base in enumerate((_R, pow(_R, -1, 2**64))):
            steps = np.full(m, base, U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, bounds, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), bounds


@dataclass
class Words:
    """Rows first..first+len(rows)-1 of a batch: words rows[i]..rows[i+1]-1 belong to the i-th."""

    first: int
    rows: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # byte positions in data
    ends: np.ndarray
    data: np.ndarray
    bounds: np.ndarray  # of the rows, in data

    def __len__(self) -> int:
        return len(self.rows) - 1


def split(column: pa.Array, lower: bool) -> Iterator[Words]:
    """Words of a batch's texts, in parts of about CHUNK bytes."""
    data, bounds = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        to = min(to, len(column))
        yield _split(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at, lower)
        at = to


def _split(data: np.ndarray, bounds: np.ndarray, first: int, lower: bool) -> Words:
    n = len(data)
    ink = np.empty(n + 2, bool)
    ink[0] = ink[-1] = False
    np.logical_not(SPACES[data], out=ink[1:-1])
    opens = ink[1:-1] & ~ink[:-2]
    shuts = ink[1:-1] & ~ink[2:]
    cuts = np.unique(bounds[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    opens[cuts] = ink[1:-1][cuts]
    shuts[cuts - 1] = ink[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((_LOWER if lower else _BYTES)[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))
    return Words(first, np.searchsorted(starts, bounds), hashes, starts, ends, data, bounds)


def shingles(words: Words, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of size words, in order, and where each row's begin.

    With whole, a row of fewer words has one shingle, all of them; without, it has none.
    """
    h, n = words.hashes, len(words.hashes)
    counts = np.diff(words.rows)
    made = np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype) if whole else 0)
    begins = np.concatenate([[0], np.cumsum(made)])
    total = int(begins[-1])
    if not total:
        return np.empty(0, U), begins
    at = np.repeat(words.rows[:-1] - begins[:-1], made) + np.arange(total)
    left = np.repeat(words.rows[1:], made) - at
    out = np.zeros(total, U)
    padded = np.concatenate([h, np.zeros(size, U)])
    for i in range(size):
        out = out * U(0x9FB21C651E98DF25) + np.where(left > i, padded[at + i], U(0))
        out ^= out >> U(29)
    return mix(out + np.minimum(left, size).astype(U)), begins


def signature(values: np.ndarray) -> bytes:
    """128 bits that stand for an array of hashes."""
    a = int(np.add.reduce(mix(values ^ U(0xA0761D6478BD642F)), dtype=U)) if len(values) else 0
    b = int(np.add.reduce(mix(values + U(0xE7037ED1A0B428DB)), dtype=U)) if len(values) else 0
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def kept(name: str, make: Callable[[], object]) -> object:
    """A worker's own `name`, kept until a task of lean() runs that doesn't keep it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _begin(keep: str | None) -> None:
    for name in [x for x in _kept if x != keep]:
        del _kept[name]


def _end() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None):  # noqa: ANN201
    """`run` for mapInArrow, which returns what its task has freed to the system: a worker stays for the whole session, beside
    those of other operators, with what it keeps of other names than `keep` dropped."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keep)
        try:
            yield from run(batches)
        finally:
            _end()

    return own

"""A request limiter by key: a fixed window that starts with the request that refills it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def step(state: tuple[int, int], now: int, limit: int, window: int) -> tuple[tuple[int, int], bool]:
    """(last refill, requests left) and a request's time: the state after it, and whether it is admitted.

    The request that finds the window over refills it and is admitted without counting, so a window after
    a refill admits limit + 1.
    """
    last, left = state
    if last < now < last + window:
        return ((last, left - 1), True) if left else (state, False)
    return (now, limit), True


def admit(requests: DataFrame, limit: int, window: int, lead: int) -> DataFrame:
    """key, id, ok of requests (key, id, at): at and window in microseconds; the state begins `lead` before a key's first request.

    A key's requests meet sorted in one task and are streamed, with two numbers of state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (0, 0)
        for batch in batches:
            out = []
            for key, at in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if key != now:
                    now, state = key, (at - lead, limit)
                state, ok = step(state, at, limit, window)
                out.append(int(ok))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(out, pa.int32())], names=["key", "id", "ok"])

    dealt = requests.select("key", "id", "at").repartition("key").sortWithinPartitions("key", "at", "id")
    kind = dict(requests.dtypes)["key"]
    return dealt.mapInArrow(run, f"key {kind}, id long, ok int")

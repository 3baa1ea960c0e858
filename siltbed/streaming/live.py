"""Streams (extensions): the limiter with state by key, and ingest into a store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limiter import step
from ..sources.store import Store


def admit_stream(requests: DataFrame, limit: int, window: int, lead: int, idle: str = "1 hour") -> DataFrame:
    """key, id, ok of a stream (key, id, at, ts). Requests of a key that arrive together are taken in order of time.

    State (two numbers a key) goes when the watermark passes `idle` after a key's last request; by then
    its window is over, so the next request refills it either way.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        now = tuple(state.get) if state.exists else (int(rows["at"].iloc[0]) - lead, limit)
        out = []
        for at in rows["at"]:
            now, ok = step(now, int(at), limit, window)
            out.append(int(ok))
        state.update((int(now[0]), int(now[1])))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["at"].max()) // 1000 + window // 1000))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "ok": out})

    kind = dict(requests.dtypes)["key"]
    watched = requests.withWatermark("ts", idle)
    return watched.groupBy("key").applyInPandasWithState(run, f"key {kind}, id long, ok int", "last long, left long", "append", GroupStateTimeout.EventTimeTimeout)


def rates(requests: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, key, n: requests by window of event time; late ones count until the watermark passes."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "key", "n")


def ingest(stream: DataFrame, store: Store, checkpoint: str, flush_every: int = 10) -> StreamingQuery:
    """A stream of (k, v, ts_us, tomb) records into a store, flushed each flush_every batches.

    A batch that is run again after a failure writes equal records again, and the newest version of a
    key stays the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        store._append(batch.select("k", F.col("v").cast("string").alias("v"), "ts_us", "tomb"))
        if (number + 1) % flush_every == 0:
            store.flush()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

"""An LRU cache over an access trace.

What a cache of C entries holds before a position is the C keys accessed last. So the trace is cut
into chunks; each gives the C keys it accessed last, these are merged from chunk to chunk, and every
chunk is then run by itself from the state before it. Memory: C entries a chunk.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _last_keys(trace: DataFrame, capacity: int, chunk: int) -> DataFrame:
    """chunk, k, at: the `capacity` keys that each chunk accessed last."""
    last = trace.groupBy(F.floor(F.col("at") / chunk).alias("chunk"), "k").agg(F.max("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("at")))
    return last.withColumn("_p", place).where(F.col("_p") <= capacity).drop("_p")


def hits(trace: DataFrame, capacity: int, chunk: int = 1 << 16, chunks: int = 1 << 10) -> DataFrame:
    """at, hit of each access (at, k); at is unique and not negative. A capacity under 1 never hits.

    Chunks are larger than `chunk` where there would be more than `chunks` of them, as their states pass through the driver."""
    chunk = max(chunk, -(-((trace.agg(F.max("at")).first()[0] or 0) + 1) // chunks))
    before: dict[int, list[str]] = {}
    held: OrderedDict[str, None] = OrderedDict()
    for row in _last_keys(trace, capacity, chunk).orderBy("chunk", "at").toLocalIterator():
        if row["chunk"] not in before:
            before[row["chunk"]] = list(held)
        held[row["k"]] = None
        held.move_to_end(row["k"])
        while len(held) > capacity:
            held.popitem(last=False)
    sent = trace.sparkSession.sparkContext.broadcast(before)  # capacity keys for each of `chunks` chunks at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, OrderedDict()
        for rows in batches:
            out = []
            for part, k in rows[["chunk", "k"]].itertuples(index=False):
                if part != now:
                    now, own = part, OrderedDict.fromkeys(sent.value.get(part, []))
                out.append(int(k in own))
                own[k] = None
                own.move_to_end(k)
                if len(own) > capacity:
                    own.popitem(last=False)
            yield pd.DataFrame({"at": rows["at"], "hit": out})

    dealt = trace.select("at", "k", F.floor(F.col("at") / chunk).alias("chunk"))
    return dealt.repartition("chunk").sortWithinPartitions("chunk", "at").mapInPandas(run, "at long, hit int")


def final_state(trace: DataFrame, capacity: int) -> DataFrame:
    """k, recency: what the cache holds in the end, 1 being the key accessed last."""
    last = trace.groupBy("k").agg(F.max("at").alias("at")).orderBy(F.desc("at")).limit(capacity)
    return last.withColumn("recency", F.row_number().over(Window.orderBy(F.desc("at")))).select("k", "recency")

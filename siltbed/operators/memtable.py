"""The memtable: distinct keys until a threshold, then a sorted run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered

#: Generations that share a folder.
SHARD = 64


def sizes(log: DataFrame, every: int) -> DataFrame:
    """bucket, n_keys: distinct keys, deleted ones included, of each `every` log rows."""
    return log.groupBy(F.floor(F.col("lsn") / every).alias("bucket")).agg(F.count_distinct("k").alias("n_keys"))


def generations(rows: DataFrame, order: str, threshold: int) -> DataFrame:
    """rows with `generation`: the flush that holds each, for distinct keys in insertion order."""
    return numbered(rows, [order], "_at").withColumn("generation", F.floor(F.col("_at") / threshold)).drop("_at")


def sorted_runs(rows: DataFrame, key: str) -> DataFrame:
    """generation, k, pos: the keys of each run in byte order. A run has no more rows than a memtable."""
    place = F.row_number().over(Window.partitionBy("generation").orderBy("k")) - 1
    return rows.select("generation", F.col(key).cast("string").alias("k")).withColumn("pos", place.cast("long"))


def flushes(log: DataFrame, threshold: int) -> DataFrame:
    """store, generation, n_keys, n_puts, first_lsn, last_lsn of the memtables of each store, from (store, k, lsn).

    A put of a key that the memtable holds replaces its value and does not make it larger; with `threshold` keys it is
    flushed. Where a memtable begins depends on all before it, so each store's log is streamed in order, with its keys as the only state."""
    names = ["store", "generation", "n_keys", "n_puts", "first_lsn", "last_lsn"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, generation, held, puts, first, last = None, 0, set(), 0, 0, 0
        for batch in batches:
            out = []
            for own, k, lsn in batch[["store", "k", "lsn"]].itertuples(index=False):
                if own != store or len(held) >= threshold:
                    if held:
                        out.append((store, generation, len(held), puts, first, last))
                    generation = generation + 1 if own == store else 0
                    store, held, puts, first = own, set(), 0, lsn
                held.add(k)
                puts, last = puts + 1, lsn
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(store, generation, len(held), puts, first, last)], columns=names)

    return log.select("store", "k", "lsn").repartition("store").sortWithinPartitions("store", "lsn").mapInPandas(fold, "store string, generation long, n_keys long, n_puts long, first_lsn long, last_lsn long")


def write_runs(rows: DataFrame, path: str) -> None:
    """Flush: a folder for each SHARD generations, its rows sorted by generation and key, so small runs do not make a file each."""
    sharded = rows.withColumn("shard", F.floor(F.col("generation") / SHARD).cast("long"))
    sharded.repartition("shard").sortWithinPartitions("shard", "generation", "k").write.mode("append").partitionBy("shard").parquet(path)

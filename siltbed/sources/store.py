"""A persistent store: a log of records, sorted runs in levels, and a manifest, all Parquet folders.

put() and delete() append a batch to the log; flush() turns the log into a sorted run at level 1 and
merges levels as compaction.plan_levels() does; reads see the log and all runs. Each change of the runs writes
a new manifest file and only then removes what the old one named, so a lost job leaves the state before it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kv

RECORD = "k string, v string, ts_us long, tomb int, lsn long"


@dataclass
class Options:
    threshold: int = 5
    depth: int = 4


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Files

    def _file(self, name: str):  # noqa: ANN202
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self._conf), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._file(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _remove(self, name: str) -> None:
        fs, at = self._file(name)
        fs.delete(at, True)

    def manifest(self) -> dict:
        """levels: generation by level; logs: folders of the log; next: the next generation; lsn: the last one given."""
        names = [n for n in self._names("manifest") if n.endswith(".json")]
        if not names:
            return {"levels": {}, "logs": [], "next": 0, "lsn": 0, "version": 0}
        rows = self.spark.read.text(f"{self.path}/manifest/{names[-1]}").collect()  # one line
        return json.loads(rows[0][0])

    def _save(self, manifest: dict) -> None:
        manifest["version"] += 1
        fs, at = self._file(f"manifest/{manifest['version']:012d}.json.tmp")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.rename(at, self._file(f"manifest/{manifest['version']:012d}.json")[1])
        for n in self._names("manifest"):
            if n < f"{manifest['version'] - 1:012d}.json":
                self._remove(f"manifest/{n}")

    # Writes

    def _append(self, rows: DataFrame) -> int:
        state = self.manifest()
        name = f"log/{state['version'] + 1:012d}"
        rows.withColumn("lsn", F.lit(state["lsn"] + 1) + F.monotonically_increasing_id()).select("k", "v", "ts_us", "tomb", "lsn").write.mode("overwrite").parquet(f"{self.path}/{name}")
        state["lsn"] = self.spark.read.parquet(f"{self.path}/{name}").agg(F.max("lsn")).first()[0] or state["lsn"]
        state["logs"].append(name)
        self._save(state)
        return state["lsn"]

    def put(self, rows: DataFrame) -> int:
        """Write (k, v, ts_us) rows; the last log sequence number."""
        return self._append(rows.select("k", F.col("v").cast("string").alias("v"), "ts_us", F.lit(0).alias("tomb")))

    def delete(self, keys: DataFrame) -> int:
        """Delete (k, ts_us) rows; keys that were never written are ignored, the others keep their value."""
        return self._append(keys.join(self.newest().select("k", "v"), "k").select("k", "v", "ts_us", F.lit(1).alias("tomb")))

    def flush(self) -> int | None:
        """The log becomes a run; the generation in which it ends, None if the log is empty."""
        state = self.manifest()
        if not state["logs"]:
            return None
        old = list(state["logs"])
        rows = self._records(state, runs=False)
        level, run, gone = 1, self._newest_records(rows), []
        while True:
            held = state["levels"].get(str(level))
            if held is not None:
                run = compaction_rows(self._run(held), run, deepest=level == self.options.depth)
                gone.append(held)
            generation = state["next"]
            state["next"] += 1
            self._write(run, generation)
            run = self._run(generation)
            if held is None or level == self.options.depth or run.count() < self.options.threshold * 2**level:
                state["levels"][str(level)] = generation
                break
            del state["levels"][str(level)]
            gone.append(generation)
            level += 1
        state["logs"] = []
        self._save(state)
        for g in gone:
            self._remove(f"runs/{g}")
        for name in old:
            self._remove(name)
        return generation

    def _write(self, rows: DataFrame, generation: int) -> None:
        """A run: range-sorted by key, so that files and row groups have narrow zones, with Bloom filters."""
        ranged = rows.repartitionByRange("k").sortWithinPartitions("k")
        ranged.write.mode("overwrite").option("parquet.bloom.filter.enabled#k", "true").parquet(f"{self.path}/runs/{generation}")

    # Reads

    def _run(self, generation: int) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(f"{self.path}/runs/{generation}")

    def _records(self, state: dict, runs: bool = True) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in state["logs"]] + [f"{self.path}/runs/{g}" for g in state["levels"].values() if runs]
        if not paths:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*paths)

    def _newest_records(self, rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("v", "ts_us", "tomb", "lsn"), F.struct("ts_us", "lsn")).alias("s")
        return rows.groupBy("k").agg(best).select("k", "s.*")

    def records(self) -> DataFrame:
        return self._records(self.manifest())

    def newest(self) -> DataFrame:
        return kv.newest(self.records())

    def get(self, key: str) -> DataFrame:
        return kv.get(self.records(), key)

    def prefix(self, start: str) -> DataFrame:
        return kv.newest(kv.prefix(self.records(), start))

    def between(self, low: str, high: str) -> DataFrame:
        return kv.newest(kv.between(self.records(), low, high))

    def live(self) -> DataFrame:
        return kv.live(self.records())

    def page(self, number: int, size: int) -> DataFrame:
        return kv.page(self.live(), number, size)


def compaction_rows(old: DataFrame, new: DataFrame, deepest: bool) -> DataFrame:
    """Two runs merged, records whole; at the deepest level deletes go."""
    best = F.max_by(F.struct("v", "ts_us", "tomb", "lsn"), F.struct("ts_us", "lsn")).alias("s")
    merged = old.unionByName(new).groupBy("k").agg(best).select("k", "s.*")
    return merged.where("tomb = 0") if deepest else merged



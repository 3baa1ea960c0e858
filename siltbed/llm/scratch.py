"""Written tables that cut lineage, in the folder that every executor shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


#: For a shared folder that is mounted (file:): no checksum files beside the tables', as their writer starts a process for each file.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@lru_cache(1)
def _own_folder() -> str:
    """One temporary folder for this process; only used in local mode."""
    return "file://" + tempfile.mkdtemp(prefix="siltbed-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only for an unset one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def set_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Keep Arrow batches small, as one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


class Scratch:
    """Parquet tables of one run; drop() frees those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/siltbed/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").options(**PLAIN).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone; leftovers are only space
            pass

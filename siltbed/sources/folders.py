"""Folders for tables that a query writes and reads again, shared by the driver and all executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="siltbed-")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's spark.checkpoint.dir (in local mode a temporary folder where it is unset), removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local()
    path = f"{root.rstrip('/')}/siltbed/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone; leftovers are only space
        pass

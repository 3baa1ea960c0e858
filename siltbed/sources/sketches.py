"""Named sketches that are stored, reopened and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SketchStore:
    """Count-min tables, HyperLogLog registers and Bloom filters, a folder of Parquet parts for each kind.

    add() appends a part, such as the sketches of a day; the readers merge all parts by name.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, kind: str, sketches: DataFrame) -> None:
        sketches.write.mode("append").parquet(f"{self.path}/{kind}")

    def _parts(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}")

    def cms(self) -> DataFrame:
        """name, r, c, n: cells add up."""
        return self._parts("cms").groupBy("name", "r", "c").agg(F.sum("n").alias("n"))

    def hll(self) -> DataFrame:
        """name, bucket, rank: registers keep the largest rank."""
        return self._parts("hll").groupBy("name", "bucket").agg(F.max("rank").alias("rank"))

    def bloom(self) -> DataFrame:
        """name, word, bits: filters of one size unite their bits."""
        return self._parts("bloom").groupBy("name", "word").agg(F.bit_or("bits").alias("bits"))

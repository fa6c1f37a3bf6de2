"""Two-generation tables: a rebuild is staged beside the live generation and swapped in whole, or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    """A table as numbered generations under a folder, and a pointer table whose last row names the live one.

    Readers that began on a generation keep it; commit refuses an empty generation where the live one has rows.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.staged = spark, folder.rstrip("/"), None

    def _pointer(self) -> str | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointer")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        row = self.spark.read.schema("seq long, name string").parquet(f"{self.folder}/pointer").orderBy(F.col("seq").desc()).first()
        return row["name"] if row else None

    def live(self) -> DataFrame | None:
        name = self._pointer()
        return None if name is None else self.spark.read.parquet(f"{self.folder}/{name}")

    def begin(self, rows: DataFrame) -> None:
        self.staged = f"gen-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{self.staged}")

    def commit(self, expected_non_empty: bool = False) -> bool:
        if self.staged is None:
            raise ValueError("nothing is staged")
        n = self.spark.read.parquet(f"{self.folder}/{self.staged}").count()
        live = self.live()
        if n == 0 and (expected_non_empty or (live is not None and not live.isEmpty())):
            self.staged = None
            return False
        last = 0 if self._pointer() is None else self.spark.read.schema("seq long, name string").parquet(f"{self.folder}/pointer").agg(F.max("seq")).first()[0]
        self.spark.range(1).select(F.lit(last + 1).cast("long").alias("seq"), F.lit(self.staged).alias("name")).write.mode("append").parquet(f"{self.folder}/pointer")
        self.staged = None
        return True

    def abort(self) -> None:
        self.staged = None

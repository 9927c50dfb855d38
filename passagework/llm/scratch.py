"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new temporary folder on a local master, which is then set, and an error elsewhere."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="passagework-")
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what runs inside are removed when it ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Parquet tables under one new folder. Writing one cuts the lineage, and a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Writes ``df`` and returns the written table. The shuffles behind it, which nothing reads again, are removed."""
        path = f"{self.root}/{name}"
        with short_shuffles(self.spark):
            df.write.mode("overwrite").parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

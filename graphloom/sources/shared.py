"""Folders that every executor can reach, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a query as soon as it has ended
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, in the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder and a cluster
    a folder in its shared SQL warehouse, which the setting then names. A
    cluster whose warehouse is a local path is an error: its executors would
    write to folders of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="spark-graphloom-", dir="/tmp")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if warehouse.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"{warehouse}/_intermediate"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write has ended, not when the driver collects its garbage."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)


class Tables:
    """Intermediate tables in the shared folder, which go when they are no longer needed.

    Writing a table cuts the lineage in a way that survives lost executors,
    runs its query once however often the result is used, and gives the
    optimizer the real size.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read back; a table of that name put before is deleted."""
        path = new_folder(self.spark, name)
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove_folder(self.spark, self.paths.pop(name))

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, which results are still read from."""
        self.drop(*[n for n in self.paths if n not in names])

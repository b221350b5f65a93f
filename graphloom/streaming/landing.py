"""Landed files as a stream into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import last_wins


def landed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_latest(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Writes the last row of each key in each batch to a folder for the batch; a batch that runs again replaces its own."""

    def one(batch: DataFrame, batch_id: int) -> None:
        last_wins(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

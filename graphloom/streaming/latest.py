"""Keyed state across the batches of a stream: the last row of each key."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    """A cell of a pandas table as a value of Spark; what is missing is None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


class LastRow(StatefulProcessor):
    """Holds one row of each key, the greatest by ``order`` (null least), and puts it out when it changes.

    With ``keep`` seconds a row goes once the watermark is so far beyond its
    ``time``; a key that comes again later begins anew.
    """

    def __init__(self, schema: StructType, keys: list[str], order: list[str], time: str, keep: float | None):
        self.schema, self.keys, self.order, self.time, self.keep = schema, keys, order, time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("last", self.schema)

    def _rank(self, row: tuple) -> tuple:
        named = dict(zip(self.schema.fieldNames(), row))
        return tuple((named[c] is not None, named[c]) if named[c] is not None else (False,) for c in self.order)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.fieldNames()
        old = tuple(self.held.get()) if self.held.exists() else None
        best = old
        for frame in rows:
            for row in frame[names].itertuples(index=False, name=None):
                row = tuple(map(_plain, row))
                if best is None or self._rank(row) > self._rank(best):
                    best = row
        if best == old:
            return
        self.held.update(best)
        if self.keep is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            at = best[names.index(self.time)]
            if at is not None:
                self.handle.registerTimer(int(at.replace(tzinfo=at.tzinfo or datetime.timezone.utc).timestamp() * 1000 + self.keep * 1000))
        yield pd.DataFrame([best], columns=names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_rows(stream: DataFrame, keys: list[str], order: list[str], time: str, late: str = "0 seconds", keep: float | None = None) -> DataFrame:
    """A stream of the last row so far, by ``order`` and against all batches before, of the keys that a batch has.

    A row that comes late, or again, changes nothing: its key's row comes out
    as it was, or not at all with ``keep``. ``late`` and ``keep`` bound
    the state: rows are dropped if they are older than the watermark, which
    trails the greatest ``time`` by ``late``, and keys are forgotten ``keep``
    seconds behind it. Without ``keep`` there is no watermark: no row is dropped and no key forgotten, and
    the state is Spark's own of an aggregation, to which each task sends one row of a key.
    Uses Spark's RocksDB state store, which ``write`` chooses.
    """
    if keep is None:
        row = F.struct(*(F.col(f"`{c}`") for c in stream.columns))
        return stream.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_last")).select("_last.*")
    source = stream.withWatermark(time, late)
    return source.groupBy(*keys).transformWithStateInPandas(LastRow(stream.schema, keys, order, time, keep), stream.schema, "Update", "EventTime")


def write(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes what changed in each batch to a folder of the batch; a batch that runs again replaces its own. The last row of each key of all folders is the table."""
    spark = rows.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return rows.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch_id={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)

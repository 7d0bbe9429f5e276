"""Catalogues and series that grow as snapshots arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def new_snapshots(stream: DataFrame, ts: str, key: str = "luid", late: str = "1 day") -> DataFrame:
    """Snapshots of a stream, each key once; keys are remembered for as long as late rows are awaited."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def write_until_done(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there now to a Parquet table and stop; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


class _Series(StatefulProcessor):
    """Anchored series of one key: rows wait until none before them can come, then they are assigned in order of time."""

    def __init__(self, limit: int, keys: Sequence[str], luid: str) -> None:
        self.limit, self.keys, self.luid = limit, list(keys), luid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, luid string")
        self.anchor = handle.getValueState("anchor", "t long, luid string")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """A timer in milliseconds, in place of the one there is."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, own, name) for own, name in rows], columns=[*self.keys, self.luid, "series_id"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            none = batch["at_micros"].isna()
            if none.any():  # without a time, a series of its own
                yield self._frame(key, [(own, own) for own in batch.loc[none, self.luid]])
            some = batch[~none]
            if len(some):
                times = some["at_micros"].astype("int64")
                self.waiting.appendList(list(zip(times.tolist(), [None if pd.isna(v) else v for v in some[self.luid]])))
                first = min(int(times.min()), first if first is not None else int(times.min()))
        if first is not None and (not self.timer.exists() or self.timer.get()[0] > -(-first // 1000)):
            self._wake(-(-first // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        due = [r for r in rows if r[0] <= passed]
        anchor, name = self.anchor.get() if self.anchor.exists() else (None, None)
        out = []
        for t, own in due:
            if anchor is None or t - anchor >= self.limit:
                anchor, name = t, own
            out.append((own, name))
        left = [tuple(r) for r in rows[len(due) :]]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        if anchor is not None and passed >= anchor + self.limit:  # all rows to come begin a new series
            self.anchor.clear()
        elif anchor is not None:
            self.anchor.update((anchor, name))
        if left:
            self._wake(-(-left[0][0] // 1000))
        elif self.anchor.exists():
            self._wake(-(-(anchor + self.limit) // 1000))
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def incremental_series(stream: DataFrame, keys: Sequence[str], ts: str, luid: str, delta_minutes: float, late: str = "1 day") -> DataFrame:
    """(keys, luid, series_id) as snapshots arrive: the anchored series of ``series_id``, whatever the order of arrival.

    A row may begin a series of its own or be cut from one by rows that arrive later and lie before it, so a row waits in its
    key's state until the watermark (the latest time less ``late``) has passed it; then its series is final and leaves.
    State: the rows of the last ``late`` of each key, and its anchor for as long as a row can join it. Rows that come later
    than ``late`` are dropped by Spark. A row without a time leaves at once. Needs the RocksDB state store (``use_rocksdb``).
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{luid}` string", "series_id string"])
    timed = stream.withWatermark(ts, late).select(*keys, F.col(luid).cast("string").alias(luid), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_micros"))
    processor = _Series(int(delta_minutes * 60_000_000), keys, luid)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keeps list states and timers on disk rather than in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_files(spark: SparkSession, schema: StructType, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of Parquet files, so many in a trigger: a backlog is worked off in pieces of bounded size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

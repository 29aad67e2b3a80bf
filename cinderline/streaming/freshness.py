"""Staleness without events: a key is current from an event on and turns stale by a timer, and what was long stale is forgotten."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cinderline.sources.tables import steps_dir

#: Timers need the state store that keeps its keys in order.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Freshness(StatefulProcessor):
    """State of a key: its newest event, in milliseconds, and whether it is stale since."""

    def __init__(self, key: str, max_age: int, keep: int):
        self.key, self.max_age, self.keep = key, max_age, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "newest long, stale boolean")

    def rows(self, key: tuple, changes: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [str(key[0])] * len(changes), "ms": [c[0] for c in changes], "state": [c[1] for c in changes]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Of a key's rows only their times are held together.
        times = np.sort(np.concatenate([pdf["event_ms"].to_numpy(np.int64) for pdf in rows]))
        known = self.state.get() if self.state.exists() else None
        newest, stale = (known[0], known[1]) if known else (None, True)
        due = newest + (self.keep + self.max_age if stale else self.max_age) if known else None
        changes = []
        for t in times.tolist():
            if newest is not None and t <= newest:
                continue
            if newest is not None and not stale and t > newest + self.max_age:
                changes.append((newest + self.max_age, "stale"))
                stale = True
            if stale:
                changes.append((t, "current"))
            newest, stale = t, False
        if newest is not None and (known is None or newest != known[0]):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(newest + self.max_age)
            self.state.update((newest, False))
        if changes:
            yield self.rows(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, stale = self.state.get()
        if stale:
            self.state.clear()
            return
        self.state.update((newest, True))
        self.handle.registerTimer(newest + self.max_age + self.keep)
        yield self.rows(key, [(newest + self.max_age, "stale")])

    def close(self) -> None:
        pass


def freshness_changes(stream: DataFrame, key: str, time: str, max_age: float, keep: float, late: str = "1 hour") -> DataFrame:
    """A row (key as text, at, state) whenever a key turns current, with an event after none or a pause of more than max_age seconds, or stale, when that time has passed without one.

    Stale rows come from timers, once the watermark passes them; the key's state goes `keep` seconds
    later. Rows that come late or repeat a time change nothing; null keys and times are left out. Times
    count in milliseconds. The result does not depend on how rows fall into batches.
    """
    seen = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = seen.select(F.col(key).cast("string").alias(key), time, F.unix_millis(time).alias("event_ms"))
    step = Freshness(key, int(max_age * 1000), int(keep * 1000))
    changes = rows.groupBy(key).transformWithStateInPandas(step, f"{key} string, ms long, state string", "append", "EventTime")
    return changes.select(key, F.timestamp_millis("ms").alias("at"), "state")


def with_ordered_state(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that an appending stream with timers gives for what is there now, as a table of this application's steps."""
    path = f"{steps_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema(stream.schema).parquet(path)

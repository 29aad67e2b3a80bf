"""The time-driven operators as Structured Streaming queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinderline.operators.history import latest_per_key
from cinderline.operators.merge import snapshot_merge
from cinderline.sources.tables import steps_dir


def distinct_documents(stream: DataFrame, hash_col: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each content hash, with state kept no longer than the lateness."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([hash_col])


def status_changes(stream: DataFrame, key: str, time: str, tie: str, value: str, forget: float | None = None, late: str = "1 hour") -> DataFrame:
    """A row (key, time, before, after) whenever a key's value differs from its last one; the first has a null before.

    The state is the last value and its order, so a row older than what was seen is ignored. With
    `forget` what comes more than that many seconds after a key's last row is a first value again, and
    its state goes once the watermark is there. Without it states stay.
    """
    out = f"{key} {stream.schema[key].dataType.simpleString()}, at timestamp, before string, after string"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen_at, seen_tie = state.get if state.exists else (None, pd.Timestamp.min, -(2**62))
        first, rows = not state.exists, []
        pdf = pd.concat(list(batches)).sort_values([time, tie])
        for at, t, v in zip(pdf[time], pdf[tie], pdf[value], strict=True):
            if (at, t) <= (seen_at, seen_tie):
                continue
            if forget is not None and not first and at > seen_at + pd.Timedelta(seconds=forget):
                first = True  # as if its timer had come between: results do not depend on how rows fall into batches
            if first or v != last:
                rows.append((k[0], at, None if first else last, v))
            last, seen_at, seen_tie, first = v, at, int(t), False
        state.update((last, seen_at, seen_tie))
        if forget is not None:
            due = int(pdf["event_ms"].max() + forget * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "at", "before", "after"])

    read = stream.select(key, F.col(time).cast("timestamp").alias(time), tie, value)
    timeout = GroupStateTimeout.NoTimeout
    if forget is not None:
        read, timeout = read.withWatermark(time, late).withColumn("event_ms", F.unix_millis(time)), GroupStateTimeout.EventTimeTimeout
    return read.groupBy(key).applyInPandasWithState(step, out, "last string, seen_at timestamp, seen_tie long", "append", timeout)


def snapshot_sink(read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame], None], key: str, keep_known: list[list[str]], now: Column, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is a full snapshot that is merged into the state; an empty one is a failed run and changes nothing. Of rows that repeat a key the newest by `order` counts, without an order any."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            single = latest_per_key(batch, key, order, order) if order else batch.dropDuplicates([key])
            write_state(snapshot_merge(read_state(), single, key, keep_known, now))

    return merge


def windowed_counts(events: DataFrame, time: str, group: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by time window and group, for streams and tables alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, length, slide) if slide else F.window(time, length), group).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def drained(stream: DataFrame) -> DataFrame:
    """What an appending stream gives for all that is there now, as a table of this application's steps."""
    path = f"{steps_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

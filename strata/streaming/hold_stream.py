"""Keyed stream state: sample-and-hold of a price feed (T3), and event-time statistics.

``hold_stream`` keeps (last kept time, its value) per feed in a state store and says of every event whether it starts
a hold period and which value is held at it; ``ordered.sample_and_hold`` is its batch twin. A timer on event time
drops a feed's state once the watermark has passed the end of its hold period: from then on the next event is kept
whatever came before. Rows older than the watermark are late and give no row. Events of one micro-batch are taken in
the order of (time, id), so micro-batches must come in the order of time for the twin's rows; an event that is earlier
than what is held counts as inside the period.

A task holds the events of one feed in one micro-batch (bounded by the source's ``maxFilesPerTrigger``), the state
store one row a feed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strata import rules as R
from strata.session import scratch_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Hold(StatefulProcessor):
    def __init__(self, hold_us: int, oid: str):
        self.hold_us, self.oid = hold_us, oid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType()), T.StructField("value", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["us", self.oid], kind="stable")
        last = self.last.get() if self.last.exists() else None
        kept, held = [], []
        for us, value in zip(events["us"].tolist(), events["value"].tolist(), strict=True):
            new = last is None or us >= last[0] + self.hold_us
            if new:
                last = (us, value)
            kept.append(new)
            held.append(last[1])
        if any(kept):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.last.update((int(last[0]), float(last[1])))
            self.handle.registerTimer(-(-(int(last[0]) + self.hold_us) // 1000))
        yield pd.DataFrame({"feed": key[0], "event_id": events[self.oid].to_numpy(), "kept": kept, "held": held})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def hold_stream(events: DataFrame, out: str, feed: str = "feed", ts: str = "ts", oid: str = "event_id", value: str = "price",
                hold_seconds: int = R.PRICE_HOLD_SECONDS, delay: str = "0 seconds") -> str:
    """Runs a stream of (feed, ts, oid, value) to the end of what is there; appends (feed, event_id, kept, held) to the
    Parquet folder ``out``/rows. The same ``out`` again resumes from the state that was kept."""
    spark = events.sparkSession
    marked = (events.withWatermark(ts, delay)
              .select(F.col(feed).cast("string").alias("feed"), F.col(ts), F.col(oid).alias("event_id"),
                      F.unix_micros(F.col(ts)).alias("us"), F.col(value).cast("double").alias("value")))
    schema = T.StructType([T.StructField("feed", T.StringType()), T.StructField("event_id", events.schema[oid].dataType),
                           T.StructField("kept", T.BooleanType()), T.StructField("held", T.DoubleType())])
    given = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        q = (marked.groupBy("feed").transformWithStateInPandas(Hold(hold_seconds * 1_000_000, "event_id"), schema, "Append", "EventTime")
             .writeStream.outputMode("append").format("parquet").option("path", os.path.join(out, "rows"))
             .option("checkpointLocation", os.path.join(out, "_ckpt")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if given is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, given)
    return os.path.join(out, "rows")


def in_time_slices(events: DataFrame, slices: int, ts: str = "ts", path: str | None = None) -> str:
    """The events written to a folder as ``slices`` appends of equal time spans, in the order of time, for a file stream
    that takes one file after another."""
    spark: SparkSession = events.sparkSession
    path = path or scratch_path(spark, f"slices-{uuid.uuid4().hex}")
    us = F.unix_micros(F.col(ts))
    low, high = events.agg(F.min(us), F.max(us)).first()
    width = 1 if low is None else (high - low) // slices + 1
    for k in range(slices):
        part = events if low is None else events.where(F.floor((us - low) / width) == k)
        part.coalesce(1).write.mode("append").parquet(path)
        if low is None:
            break
    return path


def event_counts(events: DataFrame, out: str, by: str, ts: str = "ts", window: str = "1 day", delay: str = "1 hour") -> str:
    """Counts and sums by event-time window, appended to Parquet once the watermark has passed a window's end. Events
    older than the watermark are late and not counted; windows still open when the stream ends are not written yet."""
    counted = (events.withWatermark(ts, delay).groupBy(F.window(ts, window), by)
               .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
               .select(F.col("window.start").alias("start"), by, "n", "total"))
    q = (counted.writeStream.outputMode("append").format("parquet").option("path", os.path.join(out, "rows"))
         .option("checkpointLocation", os.path.join(out, "_ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return os.path.join(out, "rows")

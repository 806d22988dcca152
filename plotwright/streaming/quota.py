"""The quota window on a stream: closed windows by timers, running counts by update; and tumbling counts (an extension) with late data bounded by a watermark."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from plotwright.operators.quota import HOURS

MICROS = 1_000_000
HOUR = 3600 * MICROS
#: Calls that a task holds before it puts them into the state.
HELD = 1 << 20


class ClosedWindows(StatefulProcessor):
    """Of one key: the open window (its start and count), and by the hour the calls that may open the next one.

    A call counts at once if it lies in the open window. Others wait until the watermark passes them, as an earlier one
    may still come; then the earliest opens a window. Timers stand at the earliest waiting call and at the open window's
    end, so windows close with the watermark, whether or not the key is called again, and a key without an open window
    or waiting calls has no state. The waiting calls of an hour are one value (16 bytes for each different time): a task
    holds one hour's, and up to ``HELD`` calls on their way there.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, n long")
        self.waiting = handle.getMapState("waiting", "hour long", "calls binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = None if key[0] is None else self.open.get()
        inside, first, parts = 0, None, []
        for b in rows:
            us = b["us"].to_numpy("int64")
            if key[0] is None:  # rows without a key only move the watermark
                continue
            if held is not None:
                mine = (held[0] <= us) & (us < held[0] + self.span)
                inside += int(mine.sum())
                us = us[~mine]
            if not len(us):
                continue
            first = int(us.min()) if first is None else min(first, int(us.min()))
            parts.append(us)
            if sum(map(len, parts)) >= HELD:
                self.keep(np.concatenate(parts))
                parts = []
        if parts:
            self.keep(np.concatenate(parts))
        if inside:
            self.open.update((held[0], held[1] + inside))
        if first is not None and held is None:
            self.wake(first)
        yield self.found([], key)

    def keep(self, us: np.ndarray) -> None:
        """Adds calls to those that wait."""
        times, n = np.unique(us, return_counts=True)
        hours, at = np.unique(times // HOUR, return_index=True)
        for hour, t, k in zip(hours.tolist(), np.split(times, at[1:]), np.split(n, at[1:]), strict=True):
            if self.waiting.containsKey((hour,)):
                before = self.calls(hour)
                t, place = np.unique(np.concatenate([before[0], t]), return_inverse=True)
                both = np.zeros(len(t), "int64")
                np.add.at(both, place, np.concatenate([before[1], k]))
                k = both
            self.put(hour, t, k)

    def calls(self, hour: int) -> np.ndarray:
        """The different times of an hour's waiting calls, in order, and how many calls each has."""
        return np.frombuffer(self.waiting.getValue((hour,))[0], "int64").reshape(2, -1)

    def put(self, hour: int, times: np.ndarray, n: np.ndarray) -> None:
        self.waiting.updateValue((hour,), (np.stack([times, n]).astype("int64").tobytes(),))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        sure = timerValues.getCurrentWatermarkInMs() * 1000  # no call up to here will come
        held, out, first = self.open.get(), [], None
        held = None if held is None else (held[0], held[1])
        for hour in sorted(int(k[0]) for k in self.waiting.keys()):
            times, n = self.calls(hour)
            at = 0
            while at < len(times):
                if held is not None and held[0] + self.span <= times[at]:
                    if held[0] + self.span > sure:
                        break
                    out.append(held)
                    held = None
                if held is None:
                    if times[at] > sure:
                        break
                    held = (int(times[at]), 0)
                to = int(np.searchsorted(times, held[0] + self.span))
                held = (held[0], held[1] + int(n[at:to].sum()))
                at = to
            if at < len(times):
                first = int(times[at])
                if at:
                    self.put(hour, times[at:], n[at:])
                break
            self.waiting.removeKey((hour,))
        if held is not None and held[0] + self.span <= sure:
            out.append(held)
            held = None
        if held is None:
            self.open.clear()
            if first is not None:
                self.wake(first)
        else:
            self.open.update(held)
            self.wake(held[0] + self.span)
        yield self.found(out, key)

    def wake(self, us: int) -> None:
        """A timer at ``us``, which lies behind the watermark when it rings."""
        self.handle.registerTimer(us // 1000 + 1)

    def found(self, out: list[tuple[int, int]], key) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="object"), "window_started_at": pd.to_datetime(pd.Series([a for a, _ in out], dtype="int64"), unit="us"), "request_count": pd.Series([n for _, n in out], dtype="int64")})

    def close(self) -> None:
        pass


def closed_windows(calls: DataFrame, key: str, ts: str, late: str = "1 hour", hours: int = HOURS) -> DataFrame:
    """(key, window_started_at, request_count) of a stream, once for each window, when the watermark reaches its end; append mode.

    Calls of any order are counted right as long as they are at most ``late`` behind the latest call of all keys; a call
    further behind is left out (Spark counts these as dropped by the watermark). Rows with a null key move the watermark
    and count nowhere, so a heartbeat closes the windows of a quiet stream.
    """
    # Timers need this state store.
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    picked = calls.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return picked.withColumn("us", F.unix_micros("ts")).groupBy("key").transformWithStateInPandas(ClosedWindows(hours * 3600 * MICROS), "key string, window_started_at timestamp, request_count long", "Append", "EventTime")


STATE = "window_started_at timestamp, request_count long"


def stream_windows(calls: DataFrame, key: str, ts: str, hours: int = HOURS) -> DataFrame:
    """(key, window_started_at, request_count) after each batch of a stream, in update mode.

    The state of a key is its open window. Calls of one batch are taken in order of time; a call
    earlier than the open window (late across batches) counts towards it.
    """
    span = datetime.timedelta(hours=hours)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, count = state.get if state.exists else (None, 0)
        out: dict = {}
        times = pd.concat([b["ts"] for b in batches]).dropna().sort_values()
        for now in times:
            now = now.to_pydatetime()
            if started is None or now >= started + span:
                started, count = now, 0
            count += 1
            out[started] = count
        if started is not None:
            state.update((started, count))
        yield pd.DataFrame({"key": [name[0]] * len(out), "window_started_at": pd.Series([*out], dtype="datetime64[ns]"), "request_count": pd.Series([*out.values()], dtype="int64")})

    picked = calls.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    return picked.groupBy("key").applyInPandasWithState(step, f"key string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def tumbling(calls: DataFrame, key: str, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling window; an extension."""
    at = calls.withColumn("at_", F.col(ts).cast("timestamp")).withWatermark("at_", late)
    return at.groupBy(F.window("at_", width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def polled(rows: DataFrame, refresh: Callable[[DataFrame, int], None], state: str, every: str = "30 seconds") -> StreamingQuery:
    """Calls ``refresh`` with what has changed, each ``every``; ``state`` is a folder of the query's own."""
    return rows.writeStream.outputMode("update").foreachBatch(refresh).option("checkpointLocation", state).trigger(processingTime=every).start()

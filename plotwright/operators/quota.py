"""Quota windows: the first call opens one of 24 hours, the first call at or after its end the next."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.storage import settle

HOURS = 24
#: Of a quota of 1000 calls a window, so many are used.
QUOTA, CUTOFF = 1000, 950


def last_of_chain(times: np.ndarray, span: int) -> np.ndarray:
    """For each call, the last call in ``times`` that opens a window, if this one does: successors followed by doubling steps."""
    to = np.searchsorted(times, times + span)
    to = np.where(to < len(times), to, np.arange(len(times)))
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def thinned(entry: np.ndarray, exit_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbours with one exit the last: whoever looks for the first entry from a time on then finds the same exit."""
    keep = np.append(exit_[1:] != exit_[:-1], True)
    return entry[keep], exit_[keep]


def first_day(times: np.ndarray, begin: int, span: int) -> int:
    """How many of ``times`` lie less than ``span`` after ``begin``, and one more: windows that reach in from before ``begin`` end by then, so a window opens at one of these."""
    return min(len(times), int(np.searchsorted(times, begin + span)) + 1)


def entries(times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, exit) of a range of one key's calls: where the first window opened in it starts, and from when on the next range may open one."""
    n = first_day(times, int(times[0]), span)
    return thinned(times[:n], times[last_of_chain(times, span)[:n]] + span)


def composed(begin: int, span: int, entry: np.ndarray, exit_: np.ndarray, next_entry: np.ndarray, next_exit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map of two neighbouring ranges, the first of which begins at ``begin``. Entries into the first go on through the second; a window that reaches beyond the first range's calls enters the second."""
    if not len(next_entry):
        return entry, exit_
    at = np.searchsorted(next_entry, exit_)
    through = np.where(at < len(next_entry), next_exit[np.minimum(at, len(next_entry) - 1)], exit_)
    n = first_day(next_entry, begin, span) if entry[-1] < begin + span else 0
    return thinned(np.concatenate([entry, next_entry[:n]]), np.concatenate([through, next_exit[:n]]))


def key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray, np.ndarray, bool]]:
    """(key, times in microseconds, calls, whether it is the partition's last) of the runs of equal keys in sorted batches."""
    name, times, counts, held = None, [], [], False
    for b in batches:
        names, t, n = b.column("key").to_pylist(), b.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(), b.column("n").to_numpy()
        edges = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
        for at, stop in zip(edges, edges[1:], strict=False):
            if held and names[at] != name:
                yield name, np.concatenate(times), np.concatenate(counts), False
                times, counts = [], []
            if stop > at:
                name, held = names[at], True
                times.append(t[at:stop])
                counts.append(n[at:stop])
    if held:
        yield name, np.concatenate(times), np.concatenate(counts), True


def windows(calls: DataFrame, key: str, ts: str, hours: int = HOURS, rows_per_task: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """(key, window_started_at, request_count). A key's calls may span any number of tasks.

    Calls are counted by key and time, and these dealt by ranges. A window's successor opens with the first call ``hours``
    later, so a range maps the time from which a window may open in it to the time from which one may open after it.
    Keys that span ranges compose their maps pairwise, in as many steps as the number of ranges has bits; on the way back
    every range learns the time at which it is entered. Then all ranges count at once, and a window's counts are added up.
    A map holds the different times of at most one window's length of a key's calls (16 bytes each, in one task), as a
    window reaches no further into a range. The driver holds two lines for each range. A null key is a key; calls without a time do not count.
    """
    spark, span = calls.sparkSession, hours * 3_600_000_000
    counted = settle(calls.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("key"), F.col(ts).alias("ts")).agg(F.count("*").alias("n")))
    parts = parts or -(-counted.count() // rows_per_task) or 1
    dealt = counted.repartitionByRange(parts, "key", "ts").sortWithinPartitions("key", "ts")
    dealt = settle(dealt) if parts > 1 else dealt
    bounds = spark.sparkContext.broadcast(entered(dealt, span) if parts > 1 else {})
    schema = T.StructType([T.StructField("key", calls.schema[key].dataType), T.StructField("window_started_at", calls.schema[ts].dataType), T.StructField("request_count", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema]
                yield b

        here = TaskContext.get().partitionId()
        out: list[tuple] = []
        for k, (name, times, counts, last) in enumerate(key_runs(noted())):
            sums = np.concatenate([[0], np.cumsum(counts)])
            since = bounds.value.get((here, 0 if k == 0 else 1)) if k == 0 or last else None
            at = 0 if since is None else int(np.searchsorted(times, since))
            if at:  # calls of the window that was open before
                out.append((name, since - span, int(sums[at])))
            while at < len(times):
                end = int(np.searchsorted(times, times[at] + span))
                out.append((name, int(times[at]), int(sums[end] - sums[at])))
                at = end
            if len(out) >= 10_000:
                yield rows(out, kinds[0])
                out = []
        if out:
            yield rows(out, kinds[0])

    def rows(out: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kinds.field("key").type), pa.array([x[1] for x in out], pa.int64()).cast(pa.timestamp("us")).cast(kinds.field("ts").type), pa.array([x[2] for x in out], pa.int64())], names=schema.names)

    found = dealt.mapInArrow(run, schema).groupBy("key", "window_started_at").agg(F.sum("request_count").alias("request_count"))
    return found.withColumnRenamed("key", key)


def entered(dealt: DataFrame, span: int) -> dict[tuple[int, int], int]:
    """{(partition, 0 for its first key or 1 for its last): time from which a window may open there}, for keys that came in from the partition before."""
    spark = dealt.sparkSession
    kind = dealt.schema["key"]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        kinds: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field("key").type]
                yield b

        for k, (name, times, _, last) in enumerate(key_runs(noted())):
            if k == 0 or last:
                a, b = entries(times, span)
                yield pa.RecordBatch.from_arrays([pa.array([here] * len(a), pa.int32()), pa.array([int(k > 0)] * len(a), pa.int32()), pa.array([name] * len(a), kinds[0]), pa.array([int(times[0])] * len(a)), pa.array([int(times[-1])] * len(a)), pa.array(a), pa.array(b)], names=schema.names)

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("key", kind.dataType), *[T.StructField(c, T.LongType()) for c in ("begin", "stop", "entry", "exit")]])
    every = settle(dealt.mapInArrow(maps, schema))
    of: dict[object, list[tuple[int, int, int, int]]] = {}
    for r in every.groupBy("part", "side").agg(F.first("key").alias("key"), F.first("begin").alias("begin"), F.first("stop").alias("stop")).collect():
        of.setdefault(r["key"], []).append((r["part"], r["side"], r["begin"], r["stop"]))
    ranges = [sorted(x) for x in of.values() if len(x) > 1]
    # Where all calls lie in the window of the first, no other opens.
    known = {(p, side): x[0][2] + span for x in ranges if x[-1][3] < x[0][2] + span for p, side, _, _ in x[1:]}
    spans = [[(p, side) for p, side, _, _ in x] for x in ranges if x[-1][3] >= x[0][2] + span]
    if not spans:
        return known
    place = F.broadcast(spark.createDataFrame([(p, side, k, node) for k, x in enumerate(spans) for node, (p, side) in enumerate(x)], "part int, side int, k int, node int"))
    level = settle(every.join(place, ["part", "side"]).select("k", "node", "begin", "entry", "exit"))
    pair = (F.col("node") / 2).cast("int")

    def compose(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("entry"), b.sort_by("entry")
        k, up, begin = (a[c][0].as_py() for c in ("k", "up", "begin"))
        entry, exit_ = composed(begin, span, *[x[c].to_numpy() for x in (a, b) for c in ("entry", "exit")])
        of_all = lambda v, t: pa.array([v] * len(entry), t)
        return pa.table([of_all(k, pa.int32()), of_all(up, pa.int32()), of_all(begin, pa.int64()), pa.array(entry, pa.int64()), pa.array(exit_, pa.int64())], names=["k", "node", "begin", "entry", "exit"])

    lefts, nodes = [], max(map(len, spans))
    while nodes > 1:
        sides = [level.where(F.col("node") % 2 == s).withColumn("up", pair).select("k", "up", "begin", "entry", "exit") for s in (0, 1)]
        lefts.append(sides[0])
        if nodes > 2:
            level = settle(sides[0].groupBy("k", "up").cogroup(sides[1].groupBy("k", "up")).applyInArrow(compose, "k int, node int, begin long, entry long, exit long"))
        nodes = -(-nodes // 2)
    since: dict[tuple[int, int], int | None] = {(k, 0): None for k in range(len(spans))}
    for left in reversed(lefts):
        asked = F.broadcast(spark.createDataFrame([(k, node, at) for (k, node), at in since.items()], "k int, up int, since long"))
        # Without a time the key's first call opens a window: its entry is the least.
        hit = left.join(asked, ["k", "up"]).where("since is null or entry >= since").groupBy("k", "up").agg(F.min_by("exit", "entry").alias("exit"))
        after = {(r["k"], r["up"]): r["exit"] for r in hit.collect()}
        since = {x: at for (k, node), e in since.items() for x, at in (((k, 2 * node), e), ((k, 2 * node + 1), after.get((k, node), e)))}
    return known | {at: since[k, node] for k, x in enumerate(spans) for node, at in enumerate(x) if since.get((k, node)) is not None}


def daily(calls: DataFrame, api: str, ts: str) -> DataFrame:
    """(api_name, request_date, request_count): the informational count per day."""
    return calls.groupBy(F.col(api).alias("api_name"), F.to_date(ts).alias("request_date")).agg(F.count("*").alias("request_count"))


def add_usage(usage: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of equal (api_name, request_date) added up; the earlier anchor stays."""
    both = usage.select("api_name", "request_date", "request_count", "window_started_at").unionByName(new.select("api_name", "request_date", "request_count", "window_started_at"))
    return both.groupBy("api_name", "request_date").agg(F.sum("request_count").alias("request_count"), F.min("window_started_at").alias("window_started_at"))


def window_used(usage: DataFrame, api: str, now: datetime.datetime, hours: int = HOURS) -> tuple[int, datetime.datetime | None]:
    """(calls of the open window, its start); (0, None) if none is open."""
    last = usage.where((F.col("api_name") == api) & F.col("window_started_at").isNotNull()).agg(F.max_by(F.struct("request_count", "window_started_at"), "window_started_at").alias("w")).first()["w"]
    if last is None or now >= last["window_started_at"] + datetime.timedelta(hours=hours):
        return 0, None
    return last["request_count"], last["window_started_at"]


def add_calls(usage: DataFrame, api: str, calls: int, now: datetime.datetime, hours: int = HOURS) -> DataFrame:
    """``usage`` after ``calls`` more at ``now``: counted to the row whose window is open, whatever its date; else a window opens in the row of the day, whose count goes on and whose anchor, if it has one, stays."""
    if not calls:
        return usage
    _, started = window_used(usage, api, now, hours)
    own = F.col("api_name") == api
    hit = own & (F.col("window_started_at") == F.lit(started)) if started is not None else own & (F.col("request_date") == F.lit(now.date()))
    at = F.lit(now).cast("timestamp_ntz")
    if usage.where(hit).limit(1).count():
        new = {"request_count": F.col("request_count") + calls, "last_updated": at, "window_started_at": F.coalesce("window_started_at", at)}
        return usage.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in new.items() if c in usage.columns})
    last = usage.agg(F.max("id")).first()[0] or 0 if "id" in usage.columns else 0
    row = usage.sparkSession.range(1).select(F.lit(last + 1).alias("id"), F.lit(api).alias("api_name"), F.lit(now.date()).alias("request_date"), F.lit(calls).alias("request_count"), at.alias("last_updated"), at.alias("window_started_at"))
    return usage.unionByName(row.select(*[F.col(f.name).cast(f.dataType) for f in usage.schema]))


class Book:
    """The calls of one API by day, carried on by the driver while a run goes on: one row a day, by the rules of ``add_calls``."""

    def __init__(self, usage: DataFrame, api: str, hours: int = HOURS):
        self.api, self.span = api, datetime.timedelta(hours=hours)
        rows = usage.where(F.col("api_name") == api).select("request_date", "request_count", "window_started_at").collect()
        self.days: dict[datetime.date, tuple[int, datetime.datetime | None]] = {r[0]: (r[1], r[2]) for r in rows}
        self.known, self.changed = set(self.days), dict[datetime.date, datetime.datetime]()

    def open_day(self, now: datetime.datetime) -> datetime.date | None:
        """The day whose row has the open window."""
        last = max((d for d, (_, at) in self.days.items() if at is not None), key=lambda d: self.days[d][1], default=None)
        return last if last is not None and now < self.days[last][1] + self.span else None

    def used(self, now: datetime.datetime) -> int:
        day = self.open_day(now)
        return 0 if day is None else self.days[day][0]

    def add(self, calls: int, now: datetime.datetime) -> None:
        if not calls:
            return
        day = self.open_day(now)
        day = now.date() if day is None else day
        count, at = self.days.get(day, (0, None))
        self.days[day], self.changed[day] = (count + calls, now if at is None else at), now

    def frame(self, usage: DataFrame) -> DataFrame:
        """``usage`` with the rows that have changed, and new ones numbered on."""
        if not self.changed:
            return usage
        last = usage.agg(F.max("id")).first()[0] or 0 if "id" in usage.columns else 0
        new = sorted(self.changed.keys() - self.known)
        rows = [(last + 1 + new.index(d) if d in new else None, self.api, d, self.days[d][0], self.changed[d], self.days[d][1]) for d in sorted(self.changed)]
        fresh = usage.sparkSession.createDataFrame(rows, "id long, api_name string, request_date date, request_count long, last_updated timestamp_ntz, window_started_at timestamp_ntz")
        of = fresh.select(*[F.col(c).alias(f"n_{c}") for c in fresh.columns])
        hit = F.col("n_api_name").isNotNull()
        joined = usage.join(F.broadcast(of), (F.col("api_name") == F.col("n_api_name")) & (F.col("request_date") == F.col("n_request_date")), "left")
        kept = joined.withColumns({c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("request_count", "last_updated", "window_started_at") if c in usage.columns}).select(*usage.columns)
        return kept.unionByName(fresh.where(F.col("request_date").isin(new)).select(*[F.col(f.name).cast(f.dataType) for f in usage.schema]))


def allowed(request_count: Column, started: Column, now: Column, cutoff: int = CUTOFF, hours: int = HOURS) -> Column:
    """Whether another call may be made: no window is open, or the open one is not used up."""
    return started.isNull() | (now >= started + F.expr(f"INTERVAL {hours} HOURS")) | (request_count < cutoff)


def stats(usage: DataFrame, now: datetime.datetime, quota: int = QUOTA, api: str = "HERE", history: int = 30, hours: int = HOURS) -> dict:
    """Usage of today and of the last days recorded, and the open window. The clock is an argument."""
    today = now.date()
    of_today = {r["api_name"]: r["request_count"] for r in usage.where(F.col("request_date") == F.lit(today)).collect()}
    past: dict[str, list[dict]] = {}
    for r in recent_days(usage, today, history).collect():
        past.setdefault(r["api_name"], []).append({"date": r["request_date"], "count": r["request_count"]})
    used, started = window_used(usage, api, now, hours)
    resets = (started + datetime.timedelta(hours=hours)).isoformat(sep=" ", timespec="minutes") if started else None
    return {"today_usage": of_today, "historical_usage": past, "here_daily_limit": quota, "here_window_used": used, "here_daily_remaining": quota - used, "here_resets_at": resets}


def recent_days(usage: DataFrame, today: datetime.date, limit: int = 30, names: Sequence[str] = ("api_name", "request_date", "request_count")) -> DataFrame:
    return usage.where(F.col("request_date") < F.lit(today)).orderBy(F.col("request_date").desc(), "api_name").select(*names).limit(limit)

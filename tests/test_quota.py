import datetime
import random

import numpy as np
import pytest

from plotwright.operators import quota
from plotwright.schemas import USAGE
from plotwright.streaming.quota import closed_windows

START = datetime.datetime(2024, 1, 1)


def hours(h):
    return START + datetime.timedelta(hours=h)


def brute(calls):
    out = {}
    for key in {k for k, _ in calls}:
        started = None
        for at in sorted(t for k, t in calls if k == key and t is not None):
            if started is None or at >= started + datetime.timedelta(hours=24):
                started = at
            out[key, started] = out.get((key, started), 0) + 1
    return sorted(((k, s, n) for (k, s), n in out.items()), key=str)


def found(spark, calls, **more):
    df = spark.createDataFrame(calls, "api string, ts timestamp_ntz, key string")
    return sorted(map(tuple, quota.windows(df, "api", "ts", **more).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 2, 7, 16])
def test_windows_over_several_tasks(spark, parts):
    rng = random.Random(parts)
    for shape in ("dense", "sparse", "bursts", "one day", "many keys"):
        span = {"dense": 300, "sparse": 20_000, "bursts": 5_000, "one day": 23, "many keys": 400}[shape]
        calls = []
        for k in range(400):
            h = rng.random() * span if shape != "bursts" else rng.choice([0, 23.99, 24, 48, 71.5, 4_000]) + rng.random() / 100
            calls.append((rng.choice("abcdefgh") if shape == "many keys" else "busy", hours(round(h, 3)), "x"))
        calls += [("other", hours(1), "x"), (None, hours(2), "x"), (None, hours(30), "x"), ("busy", None, "x"), ("busy", hours(5), "x"), ("busy", hours(5), "x")]
        assert found(spark, calls, parts=parts) == brute([(k, t) for k, t, _ in calls]), shape


def test_no_calls(spark):
    assert found(spark, []) == [] and found(spark, [("a", None, "x")], parts=4) == []


def test_maps_compose_to_the_whole(spark):
    rng = np.random.default_rng(5)
    span = 1_000
    for _ in range(200):
        times = np.unique(rng.integers(0, int(rng.choice([900, 5_000, 60_000])), int(rng.integers(1, 200))))
        cuts = sorted(rng.integers(0, len(times) + 1, 3).tolist())
        ranges = [r for r in np.split(times, cuts) if len(r)]
        maps = [(int(r[0]), *quota.entries(r, span)) for r in ranges]
        while len(maps) > 1:  # pairwise
            maps = [(a[0], *quota.composed(a[0], span, *a[1:], *b[1:])) for a, b in zip(maps[::2], [*maps[1::2], *[(0, np.zeros(0, int), np.zeros(0, int))] * (len(maps) % 2)], strict=True)]
        _, entry, exit_ = maps[0]
        for since in [int(times[0]), *rng.integers(int(times[0]) - span, int(times[0]) + span + 1, 5).tolist()]:
            at, k = since, int(np.searchsorted(times, since))
            while k < len(times):
                at = int(times[k]) + span
                k = int(np.searchsorted(times, at))
            j = int(np.searchsorted(entry, since))
            assert at == (exit_[j] if j < len(entry) else since)


def test_book_counts_as_the_table_does(spark):
    rng = random.Random(2)
    usage = spark.createDataFrame([(1, "HERE", datetime.date(2023, 12, 31), 4, None, datetime.datetime(2023, 12, 31, 20)), (2, "OSM", datetime.date(2024, 1, 1), 9, None, None), (3, "HERE", datetime.date(2024, 1, 3), 2, None, None)], USAGE)
    book, table = quota.Book(usage, "HERE"), usage
    at = hours(1)
    for _ in range(8):
        at += datetime.timedelta(hours=rng.choice([1, 5, 19, 24, 30]))
        n = rng.choice([0, 1, 7])
        assert book.used(at) == quota.window_used(table, "HERE", at)[0]
        book.add(n, at)
        table = quota.add_calls(table, "HERE", n, at)
    columns = ["api_name", "request_date", "request_count", "window_started_at"]
    assert sorted(map(tuple, book.frame(usage).select(*columns).collect()), key=str) == sorted(map(tuple, table.select(*columns).collect()), key=str)
    assert book.frame(usage).where("id is null").count() == 0


def test_stream_windows_close_at_their_end_and_leave_no_state(spark, tmp_path):
    def feed(*calls):
        spark.createDataFrame([*calls], "api string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("api string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
        run = closed_windows(stream, "api", "ts", late="2 hours").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        run.awaitTermination(120)
        steps = [p.stateOperators[0] for p in run.recentProgress if p.stateOperators]
        closed = sorted((r.key, (r.window_started_at - START).total_seconds() / 3600, r.request_count) for r in spark.read.parquet(f"{tmp_path}/out").collect()) if list((tmp_path / "out").glob("*.parquet")) else []
        return closed, steps[-1].numRowsTotal if steps else None, sum(s.numRowsDroppedByWatermark for s in steps)

    # Out of order within the bound: the earliest call opens the window, also if it comes last.
    closed, state, _ = feed(("a", hours(3)), ("a", hours(2)), ("b", hours(4)))
    assert closed == [] and state > 0
    closed, _, dropped = feed(("a", hours(2.5)), ("a", hours(26.5)), ("a", hours(25.9)))
    assert closed == [] and dropped == 0
    # The watermark passes a's end: the call at its very end opens the next one; b is open still.
    closed, _, _ = feed((None, hours(28.2)))
    assert closed == [("a", 2.0, 4)]
    # A call further behind is left out; others go on.
    closed, _, dropped = feed(("b", hours(10)), ("b", hours(27.9)))
    assert dropped == 1 and closed == [("a", 2.0, 4)]
    closed, state, _ = feed((None, hours(200)))
    assert closed == [("a", 2.0, 4), ("a", 26.5, 1), ("b", 4.0, 2)] and state == 0


def test_stream_windows_match_the_batch(spark, tmp_path):
    rng = random.Random(4)
    calls = sorted((hours(round(rng.random() * 400, 4)), rng.choice("abc")) for _ in range(300))
    for k in range(0, 300, 100):
        part = calls[k : k + 100]
        rng.shuffle(part)
        spark.createDataFrame([(a, t) for t, a in part], "api string, ts timestamp_ntz").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("api string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
        closed_windows(stream, "api", "ts", late="150 hours").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    spark.createDataFrame([(None, hours(9999))], "api string, ts timestamp_ntz").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("api string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
    closed_windows(stream, "api", "ts", late="150 hours").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    got = sorted(((r.key, r.window_started_at, r.request_count) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == brute([(a, t) for t, a in calls])


def test_stream_windows_keep_an_hour_of_calls_as_one_value(spark, tmp_path):
    rng = random.Random(7)
    calls = [("a", hours(rng.random() * 60)) for _ in range(3000)]
    calls += calls[:500]
    read = lambda: closed_windows(spark.readStream.schema("api string, ts timestamp_ntz").parquet(f"{tmp_path}/in"), "api", "ts", late="30 hours")
    for rows in (calls, [(None, hours(9999))]):
        spark.createDataFrame(rows, "api string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = read().writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        run.awaitTermination(120)
        if rows is calls:  # some 30 hours wait, the open window and the timer's two entries
            assert max(p.stateOperators[0].numRowsTotal for p in run.recentProgress) < 80
    got = sorted(((r.key, r.window_started_at, r.request_count) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == brute(calls)

import pytest

from plotwright import storage
from plotwright.storage import Conflict, Ledger


class Stopped(BaseException):
    """The writer is lost: nothing after it runs, its clearing up included."""


def counts(ledger):
    return {n: ledger.read(n).count() for n in ledger.tables()}


class Dying:
    """A file system that is lost before, or after, its n-th change."""

    def __init__(self, fs, at, after):
        self.fs, self.at, self.after, self.n = fs, at, after, 0

    def __getattr__(self, name):
        real = getattr(self.fs, name)
        if name not in ("create", "delete", "rename", "mkdirs"):
            return real

        def change(*a):
            self.n += 1
            if self.n > self.at or (self.n == self.at and not self.after):
                raise Stopped
            out = real(*a)
            if self.n == self.at:
                raise Stopped
            return out

        return change


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("at", range(1, 6))
def test_a_lost_writer_leaves_the_old_tables_or_the_new(spark, tmp_path, at, after):
    folder = str(tmp_path / "store")
    for k in (1, 2, 3):
        Ledger(spark, folder).commit({"a": spark.range(k), "b": spark.range(10 * k)})
    writer = Ledger(spark, folder)
    writer.fs = Dying(writer.fs, at, after)
    try:
        writer.commit({"a": spark.range(5), "b": spark.range(50), "c": spark.range(7)})
    except (Stopped, Exception):
        pass
    found = counts(Ledger(spark, folder))
    assert found in ({"a": 3, "b": 30}, {"a": 5, "b": 50, "c": 7})
    # The next writer goes on from there, and what nobody names can be cleared away.
    Ledger(spark, folder).commit({"b": spark.range(4)})
    assert counts(Ledger(spark, folder)) == found | {"b": 4}
    Ledger(spark, folder).vacuum()
    named = {p for v in Ledger(spark, folder).versions() for p in Ledger(spark, folder).named(v).values()}
    assert {f"tables/{p.name}" for p in (tmp_path / "store/tables").iterdir()} == named


@pytest.mark.parametrize("step", ["write", "place", "rename", "clear"])
def test_a_writer_stopped_at_each_step(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "store")
    Ledger(spark, folder).commit({"a": spark.range(1), "b": spark.range(2)})
    old, new = {"a": 1, "b": 2}, {"a": 10, "b": 20}
    ledger = Ledger(spark, folder)
    tables = {"a": spark.range(10), "b": spark.range(20)}
    if step == "write":
        tables["b"] = spark.range(20).selectExpr("raise_error('lost') AS id")
    elif step == "place":
        monkeypatch.setattr(Ledger, "place", lambda *a: (_ for _ in ()).throw(Stopped()))
    elif step == "rename":
        real = Ledger.place
        monkeypatch.setattr(Ledger, "place", lambda *a: (real(*a), (_ for _ in ()).throw(Stopped())))
    else:
        monkeypatch.setattr(Ledger, "clear", lambda *a: (_ for _ in ()).throw(Stopped()))
    with pytest.raises((Stopped, Exception)):
        ledger.commit(tables)
    monkeypatch.undo()
    assert counts(Ledger(spark, folder)) == (old if step in ("write", "place") else new)


def test_of_two_writers_one_fails(spark, tmp_path):
    folder = str(tmp_path / "store")
    Ledger(spark, folder).commit({"a": spark.range(1)})
    slow = Ledger(spark, folder)
    slow.versions = lambda: [1]  # as it was when this writer began
    Ledger(spark, folder).commit({"a": spark.range(2)})
    with pytest.raises(Conflict):
        slow.commit({"a": spark.range(3)})
    assert counts(Ledger(spark, folder)) == {"a": 2} and len(list((tmp_path / "store/tables").iterdir())) == 2


def test_tables_may_be_made_from_themselves_and_old_versions_go(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.commit({"a": spark.range(1)}, {"run": "runs/x"})
    for _ in range(5):
        a = ledger.read("a")
        ledger.commit({"a": a.unionByName(a)})
    assert counts(ledger.__class__(spark, str(tmp_path))) if "run" not in ledger.tables() else ledger.read("a").count() == 32
    assert len(ledger.versions()) == Ledger.KEPT and len(list((tmp_path / "tables").iterdir())) == Ledger.KEPT
    ledger.commit({}, {"run": None})
    assert [*ledger.tables()] == ["a"]
    with pytest.raises(FileNotFoundError):
        ledger.read("run")


def test_kept_intermediates_are_deleted_when_let_go(tmp_path):
    """A session as the engine makes it, in a process of its own, as the setting is made at its start."""
    import subprocess
    import sys

    code = f"""
import gc, os, sys, time
from plotwright.session import session
from plotwright.storage import settle
spark = session("t", spark__master="local[2]", spark__checkpoint__dir={str(tmp_path)!r}, spark__ui__enabled="false")
size = lambda: sum(len(f) for _, _, f in os.walk({str(tmp_path)!r}))
for _ in range(3):
    df = settle(spark.range(1000))
    assert df.count() == 1000
    del df
    gc.collect()
    spark._jvm.System.gc()
for _ in range(60):
    if size() == 0: break
    time.sleep(0.5); gc.collect(); spark._jvm.System.gc()
print("left", size())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert "left 0" in out.stdout, out.stdout + out.stderr[-2000:]


def test_scratch_folders_are_shared_and_new(spark):
    assert storage.scratch(spark, "x") != storage.scratch(spark, "x")

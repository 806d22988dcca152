"""Where intermediate and final tables are kept."""

from __future__ import annotations

import datetime
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder of ``spark.checkpoint.dir``. Where none is set, a temporary one serves a local master; elsewhere that raises, as executors could not read it. Sessions made by ``plotwright.session`` delete it when ``df`` is let go."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plotwright-"))
    return df.checkpoint()


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def exists(spark: SparkSession, path: str) -> bool:
    fs, make = file_system(spark, path)
    return bool(fs.exists(make(path)))


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Renames ``staged`` to ``path``; what was there is set aside first, put back if that fails, and deleted last."""
    fs, make = file_system(spark, path)
    old = f"{path}.old-{uuid.uuid4().hex}"
    moved = fs.exists(make(path)) and fs.rename(make(path), make(old))
    if not fs.rename(make(staged), make(path)):
        if moved:
            fs.rename(make(old), make(path))
        raise OSError(f"could not publish {path}")
    if moved:
        fs.delete(make(old), True)


def publish(df: DataFrame, path: str, **options: str) -> None:
    """Parquet at ``path``, whole or not at all: written beside it, then renamed. The rows may come from ``path`` itself."""
    spark = df.sparkSession
    fs, make = file_system(spark, path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    try:
        df.write.options(**options).parquet(staged)
        swap(spark, staged, path)
    finally:
        if fs.exists(make(staged)):
            fs.delete(make(staged), True)


def backup(tables: dict[str, DataFrame], folder: str, now: datetime.datetime | None = None) -> str:
    """A copy of the tables in a folder named for the time; returns it."""
    at = f"{folder}/backup-{(now or datetime.datetime.now()):%Y%m%d-%H%M%S}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{at}/{name}")
    return at


def restore(spark: SparkSession, at: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{at}/{n}") for n in names}


class Conflict(OSError):
    """Another writer has committed since the version that this commit was based on."""


class Ledger:
    """Tables below one folder, all swapped by one rename.

    Each table is written to a folder of its own. A version is a numbered file that names the folders of all
    tables; it is written beside and renamed into place, and that is the commit: readers take the greatest
    number, so they find the old tables or the new ones, whenever a writer stops. A rename does not replace, so
    of two writers one fails. ``KEPT`` versions stay for readers that are under way; what only older ones name is
    deleted after the commit, or after the next, if the writer is lost before that.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs, self.make = file_system(spark, folder)

    def versions(self) -> list[int]:
        at = self.make(f"{self.folder}/_versions")
        found = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in found if re.fullmatch(r"\d+\.json", n))

    def named(self, version: int) -> dict[str, str]:
        """The folders of the tables of a version, below this one's folder."""
        if not version:
            return {}
        stream = self.fs.open(self.make(self.file(version)))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def file(self, version: int) -> str:
        return f"{self.folder}/_versions/{version:012d}.json"

    def tables(self) -> dict[str, str]:
        return self.named(max(self.versions(), default=0))

    def path(self, name: str) -> str | None:
        found = self.tables().get(name)
        return None if found is None else f"{self.folder}/{found}"

    def read(self, name: str) -> DataFrame:
        path = self.path(name)
        if path is None:
            raise FileNotFoundError(f"{self.folder} has no table {name}")
        return self.spark.read.parquet(path)

    def commit(self, tables: dict[str, DataFrame], links: dict[str, str | None] | None = None) -> int:
        """Replaces ``tables``, and sets entries to folders that are there already (``links``; None drops one). The rows may come from the tables themselves. Returns the version."""
        base = max(self.versions(), default=0)
        new = {name: f"tables/{name}-{uuid.uuid4().hex}" for name in tables}
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.folder}/{new[name]}")
            named = self.named(base) | new | (links or {})
            self.place({k: v for k, v in named.items() if v is not None}, base + 1)
        except BaseException:
            if max(self.versions(), default=0) == base or not set(new.values()) <= set(self.tables().values()):
                for at in new.values():
                    self.fs.delete(self.make(f"{self.folder}/{at}"), True)
            raise
        self.clear()
        return base + 1

    def place(self, named: dict[str, str], version: int) -> None:
        beside = self.make(f"{self.folder}/_versions/.{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(named, sort_keys=True).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        target = self.make(self.file(version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(target), how)
        except Exception as e:
            self.fs.delete(beside, False)
            if self.fs.exists(target):
                raise Conflict(f"version {version} of {self.folder} is taken") from e
            raise

    def clear(self) -> None:
        """Deletes older versions and the folders that only they name."""
        every = self.versions()
        stay = {at for v in every[-self.KEPT :] for at in self.named(v).values()}
        for v in every[: -self.KEPT]:
            for at in set(self.named(v).values()) - stay:
                self.fs.delete(self.make(f"{self.folder}/{at}"), True)
            self.fs.delete(self.make(self.file(v)), False)

    def vacuum(self) -> list[str]:
        """Deletes the folders that no version names, as writers leave them that were lost before their commit. For times without writers."""
        stay = {at for v in self.versions() for at in self.named(v).values()}
        top = self.make(f"{self.folder}/tables")
        gone = [f"tables/{f.getPath().getName()}" for f in self.fs.listStatus(top)] if self.fs.exists(top) else []
        gone = sorted(set(gone) - stay)
        for at in gone:
            self.fs.delete(self.make(f"{self.folder}/{at}"), True)
        return gone


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared folder of intermediate tables."""
    settle(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

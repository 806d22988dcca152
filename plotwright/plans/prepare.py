"""Whole runs: from a raw file to published tables, and from those to exports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright import schemas, storage
from plotwright.functions.values import in_bounds
from plotwright.operators import cache, dedup, geocode, impute, marts, quality
from plotwright.operators.answers import Answers
from plotwright.operators.clean import PARTIES, clean
from plotwright.operators.validate import require_key, require_reference
from plotwright.sources import exports, tables
from plotwright.sources.providers import Result


@dataclass(frozen=True)
class Store:
    """The published tables below one folder: those of its ledger, or the folder of that name."""

    spark: SparkSession
    folder: str

    @property
    def ledger(self) -> storage.Ledger:
        return storage.Ledger(self.spark, self.folder)

    def read(self, name: str, empty=None) -> DataFrame:
        path = self.ledger.path(name) or f"{self.folder}/{name}"
        if empty is not None and not storage.exists(self.spark, path):
            return self.spark.createDataFrame([], empty)
        return self.spark.read.parquet(path)


class Cached:
    """Published tables for reports: read once, kept by the executors, and read again after ``seconds`` (a table may have been published anew)."""

    def __init__(self, store: Store, seconds: float = 600, clock: Callable[[], float] = time.monotonic):
        self.store, self.seconds, self.clock = store, seconds, clock
        self.held: dict[str, tuple[float, DataFrame]] = {}

    def read(self, name: str) -> DataFrame:
        since, df = self.held.get(name, (None, None))
        if df is not None and self.clock() - since < self.seconds:
            return df
        if df is not None:
            df.unpersist()
        self.store.spark.catalog.refreshByPath(self.store.ledger.path(name) or f"{self.store.folder}/{name}")
        self.held[name] = (self.clock(), self.store.read(name).cache())
        return self.held[name][1]


def prepare(spark: SparkSession, raw_csv: str, folder: str, keep_tables: bool = False) -> dict[str, int]:
    """Loads, cleans and publishes sales, addresses and mappings; nothing is published if a check fails."""
    store = Store(spark, folder)
    tables.load_csv(spark, raw_csv, f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    sales = storage.settle(clean(raw))
    known = storage.settle(cache.upsert(store.read("addresses", schemas.ADDRESSES), sales))
    maps = storage.settle(cache.mappings(sales, known))
    require_key(known, ["address"])
    require_reference(maps, sales, {"housing_id": "unique_id"})
    require_reference(maps, known, {"address_id": "address_id"})
    store.ledger.commit({"sales": sales, "addresses": known, "mappings": maps})
    if not keep_tables:
        fs, make = storage.file_system(spark, folder)
        fs.delete(make(f"{folder}/raw"), True)
    return {"sales": sales.count(), "addresses": known.count(), "mappings": maps.count()}


def impute_from_snapshot(spark: SparkSession, snapshot_csv: str, folder: str) -> DataFrame:
    """Marks and fills addresses against the source snapshot; returns the summary row."""
    store = Store(spark, folder)
    sales = store.read("sales")
    out = impute.mark_provenance(sales, tables.read_snapshot(spark, snapshot_csv), PARTIES)
    out = impute.fill(out, ["parcel_id"], *PARTIES[0])
    out = storage.settle(impute.fill(out, ["parcel_id", "owner_name"], *PARTIES[1]))
    store.ledger.commit({"sales": out})
    return impute.summary(out, PARTIES)


def geocode_pending(spark: SparkSession, folder: str, make: Callable[[int], Callable[[str], Result]], address_type: str | None = None, **options) -> dict:
    """Asks for the mapped addresses that lack a place; publishes the cache and the usage counter, which the next run goes on from. A killed run is taken up where it was. Returns the report."""
    store = Store(spark, folder)
    run = store.ledger.tables().get("geocode_run")
    if run is None:  # else a run was killed: it goes on from the answers that it kept
        run = f"runs/{uuid.uuid4().hex}"
        store.ledger.commit({}, {"geocode_run": run})
    known, usage = store.read("addresses"), store.read("usage", schemas.USAGE)
    ids = cache.mapped_ids(store.read("mappings"), known, address_type, pending=True)
    known, usage, report = geocode.bulk(known, ids, make, F.current_timestamp().cast("timestamp_ntz"), usage, log=f"{folder}/{run}", **options)
    # The run's entry goes with the same commit, so its answers are merged once.
    store.ledger.commit({"addresses": known, "usage": usage}, {"geocode_run": None})
    Answers(spark, f"{folder}/{run}").drop()
    return report


def maintain(spark: SparkSession, folder: str) -> DataFrame:
    """Removes later duplicates and what hangs on them, lists new placeholder issues; returns the overview row."""
    store = Store(spark, folder)
    sales, maps, issues = dedup.delete_with_dependents(store.read("sales"), store.read("mappings", schemas.MAPPINGS), store.read("issues", schemas.ISSUES), schemas.SALE_KEY)
    sales, maps = storage.settle(sales), storage.settle(maps)
    issues = storage.settle(issues.unionByName(quality.placeholder_issues(sales, issues)))
    store.ledger.commit({"sales": sales, "mappings": maps, "issues": issues})
    return quality.overview(sales, issues, schemas.SALE_KEY)


def export(spark: SparkSession, folder: str, target: str, single: bool = True) -> None:
    """``target/full`` and ``target/public``, the second without the owners' places, from one pass; both or neither."""
    store = Store(spark, folder)
    exports.export(marts.export_rows(store.read("sales"), store.read("mappings"), store.read("addresses")), target, single=single)


def out_of_bounds(cache_rows: DataFrame) -> DataFrame:
    return cache_rows.where(~in_bounds(F.col("latitude"), F.col("longitude")))

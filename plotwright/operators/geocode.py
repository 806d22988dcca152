"""Geocoding as tables: what is pending, what providers answer, what the cache then holds, and corrections by hand."""

from __future__ import annotations

import datetime
import functools
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.functions.text import full_address
from plotwright.functions.values import needs_geocoding, point
from plotwright.operators import quota
from plotwright.operators.answers import Answers
from plotwright.operators.cache import numbered
from plotwright.operators.quota import CUTOFF
from plotwright.operators.validate import require_unique
from plotwright.schemas import CORRECTION_LOG, GEOCODE_RESULT, USAGE
from plotwright.sources import lookups
from plotwright.sources.providers import Provider, Result
from plotwright.storage import scratch

USED_UP = lookups.USED_UP


def pending(cache: DataFrame, ids: DataFrame | None = None, force: bool = False, limit: int | None = None) -> DataFrame:
    """(address_id, full_address) to be asked for: without coordinates (all, if ``force``), among ``ids`` if given, least ids first."""
    rows = cache if force else cache.where(needs_geocoding(F.col("latitude"), F.col("longitude")))
    if ids is not None:
        rows = rows.join(ids.select("address_id"), "address_id", "left_semi")
    address = F.coalesce("address_standardized", "address")
    out = rows.select("address_id", full_address(address, F.col("city")).alias("full_address")).where("full_address is not null")
    return out.orderBy("address_id").limit(limit) if limit is not None else out


def chain(primary: Provider, fallback: Provider | None, used: int = 0, cutoff: int = CUTOFF) -> Callable[[str], Result]:
    """Asks ``primary``, then ``fallback`` while its quota lasts. A failure of both is the last one's."""
    count = used

    def ask(address: str) -> Result:
        nonlocal count
        first = primary.geocode(address)
        if first.success or fallback is None:
            return first
        if count >= cutoff:
            return Result(False, source=fallback.name, message=USED_UP)
        count += 1
        return fallback.geocode(address)

    return ask


def resolve(asked: DataFrame, make: Callable[[], Callable[[str], Result]], parallel: int = 1) -> DataFrame:
    """``asked`` with the providers' answers. One partition by default, as rate limits hold for the whole run."""
    schema = f"address_id long, full_address string, {RESULT}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for batch in batches:
            answers = pd.DataFrame([ask(a).row() for a in batch["full_address"]], columns=[f.name for f in GEOCODE_RESULT])
            yield pd.concat([batch.reset_index(drop=True), answers], axis=1)

    dealt = asked.coalesce(1) if parallel == 1 else asked.repartition(parallel)
    return dealt.mapInPandas(run, schema)


def store(cache: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The cache with ``results``: place and address are the answer's (null on failure), geocoded_at is set once. Results that repeat an id are refused."""
    require_unique(results, "address_id")
    r = results.select(F.col("address_id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in ("success", "latitude", "longitude", "corrected_address", "confidence", "source")])
    hit = F.col("r_id").isNotNull()
    new = {
        "latitude": F.col("r_latitude"),
        "longitude": F.col("r_longitude"),
        "corrected_address": F.col("r_corrected_address"),
        "geocode_confidence": F.col("r_confidence"),
        "geocode_source": F.col("r_source"),
        "geocode_status": F.when(F.col("r_success"), "GEOCODED").otherwise("FAILED"),
        "geocoded_at": F.coalesce("geocoded_at", now),
        "last_updated": now,
        "geom": F.coalesce(point(F.col("r_latitude"), F.col("r_longitude")), F.col("geom")),
    }
    return cache.join(r, cache["address_id"] == r["r_id"], "left").withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in new.items()}).select(*cache.columns)


RESULT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in GEOCODE_RESULT)
ANSWER = f"address_id long, full_address string, {RESULT}, asked_at timestamp_ntz"
#: Asks for (address_id, full_address), given the calls that the open window has seen; the answers as ``resolve`` has them.
Ask = Callable[[DataFrame, int], DataFrame]


def bulk(
    cache: DataFrame,
    ids: DataFrame,
    make: Callable[[int], Callable[[str], Result]],
    now: Column,
    usage: DataFrame | None = None,
    batch_size: int = 100,
    force: bool = False,
    api: str = "HERE",
    cutoff: int = CUTOFF,
    clock: Callable[[], datetime.datetime] = datetime.datetime.now,
    log: str | None = None,
    ask: Ask | None = None,
) -> tuple[DataFrame, DataFrame, dict]:
    """(cache, usage, report) after the pending addresses among ``ids``, in batches of ids.

    Answers are appended to ``log``, a folder, batch by batch, and merged into the cache once, at the end. A run that
    was killed goes on with the same ``log``: batches kept are not asked for again, and their calls count. ``make`` gets the
    calls to ``api`` that the open window has seen, by ``usage``, the persistent counter, and the batches so far; the run
    stops after the batch that reaches ``cutoff``. What could not be asked for is left as it was. ``ask`` stands in for
    asking in one task through ``make`` (see ``plotwright.sources.lookups``).
    """
    spark = cache.sparkSession
    usage = spark.createDataFrame([], USAGE) if usage is None else usage
    ask = ask or (lambda part, used: resolve(part, functools.partial(make, used)))
    answers = Answers(spark, log or scratch(spark, "answers"))
    batches, done = answers.plan(pending(cache, ids, force), batch_size), answers.done()
    book, began, stopped = quota.Book(usage, api), time.monotonic(), False
    over = F.coalesce(F.col("message") == USED_UP, F.lit(False))
    calls = F.count_if((F.col("source") == api) & ~over)
    if done:
        for r in answers.read(ANSWER).groupBy("batch").agg(calls.alias("calls"), F.min("asked_at").alias("at")).where("calls > 0").orderBy("batch").collect():
            book.add(r["calls"], r["at"])
        stopped = book.used(clock()) >= cutoff
    for k in range(batches):
        if stopped:
            break
        if k in done:
            continue
        at = clock()
        kept = answers.add(k, ask(answers.part(k), book.used(at)).withColumn("asked_at", F.lit(at).cast("timestamp_ntz")))
        late, new = kept.agg(F.count_if(over), calls).first()
        book.add(new, at)
        stopped = late > 0 or book.used(at) >= cutoff
    found = answers.read(ANSWER).where(~over)
    asked, geocoded = found.agg(F.count("*"), F.count_if("success")).first()
    seconds = time.monotonic() - began
    share = lambda x: x / asked if asked else 0.0
    report = {"asked": asked, "geocoded": geocoded, "failed": asked - geocoded, "stopped": stopped, "success_rate": share(geocoded), "seconds": seconds, "seconds_per_address": share(seconds)}
    return store(cache, found, now), book.frame(usage), report


def correct(cache: DataFrame, corrections: DataFrame, log: DataFrame, now: Column, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cache, log) after corrections by hand (address_id, corrected_address, latitude, longitude, changed_by, reason).

    One log row if the corrected text differs; another if a coordinate does and both new ones are given.
    Ids that the cache lacks are not corrected. Several corrections of an id are applied in the ``order`` of
    that column, each logged against the one before it; without ``order`` they are refused.
    """
    if order is None:
        require_unique(corrections, "address_id")
    wanted = ["address_id", "corrected_address", "latitude", "longitude", "changed_by", "reason"]
    n = corrections.where("address_id is not null").select(*[F.col(c).alias(f"n_{c}") for c in wanted], (F.col(order) if order else F.lit(0)).alias("n_order"))
    w = Window.partitionBy("n_address_id").orderBy("n_order", *[f"n_{c}" for c in wanted[1:]])
    n = n.withColumns({"n_step": F.row_number().over(w), "n_final": F.lead("n_address_id").over(w).isNull()} | {f"b_{c}": F.lag(f"n_{c}").over(w) for c in wanted[1:4]})
    hit = F.col("n_address_id").isNotNull()
    joined = cache.join(n.where("n_final"), cache["address_id"] == n["n_address_id"], "left")
    new = {c: F.col(f"n_{c}") for c in wanted[1:4]} | {"geocode_status": F.lit("MANUALLY_CORRECTED"), "last_updated": now, "geom": F.coalesce(point(F.col("n_latitude"), F.col("n_longitude")), F.col("geom"))}
    out = joined.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in new.items()}).select(*cache.columns)

    steps = n.join(cache.select("address_id", *wanted[1:4]), F.col("n_address_id") == F.col("address_id"))
    old = {c: F.when(F.col("n_step") == 1, F.col(c)).otherwise(F.col(f"b_{c}")) for c in wanted[1:4]}
    both = F.col("n_latitude").isNotNull() & F.col("n_longitude").isNotNull()
    moved = both & ~(old["latitude"].eqNullSafe(F.col("n_latitude")) & old["longitude"].eqNullSafe(F.col("n_longitude")))
    pair = lambda a, b: F.format_string("(%s, %s)", F.coalesce(a.cast("string"), F.lit("None")), F.coalesce(b.cast("string"), F.lit("None")))
    entries = F.array_compact(
        F.array(
            F.when(~old["corrected_address"].eqNullSafe(F.col("n_corrected_address")), F.struct(F.lit(1).alias("k"), old["corrected_address"].alias("original_value"), F.col("n_corrected_address").alias("new_value"), F.lit("corrected_address").alias("field_changed"))),
            F.when(moved, F.struct(F.lit(2).alias("k"), pair(old["latitude"], old["longitude"]).alias("original_value"), pair(F.col("n_latitude"), F.col("n_longitude")).alias("new_value"), F.lit("coordinates").alias("field_changed"))),
        )
    )
    rows = steps.select("address_id", "n_step", F.explode(entries).alias("e"), "n_changed_by", "n_reason").select("address_id", "n_step", "e.*", F.col("n_changed_by").alias("changed_by"), now.alias("changed_at"), F.col("n_reason").alias("reason"))
    last = log.agg(F.max("id")).first()[0] or 0
    added = numbered(rows, ["address_id", "n_step", "k"], "id", last)
    return out, log.unionByName(added.select(*[F.col(f.name).cast(f.dataType) for f in CORRECTION_LOG]))


def recent_results(cache: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Latest first; rows never geocoded come first of all."""
    rows = cache if status is None else cache.where(F.col("geocode_status") == status)
    return rows.orderBy(F.col("geocoded_at").desc_nulls_first(), "address_id").limit(limit)


def listed(cache: DataFrame, status: str | None = None, limit: int = 1000) -> DataFrame:
    """The dashboard's list: latest first, rows never geocoded last."""
    rows = cache if status is None else cache.where(F.col("geocode_status") == status)
    return rows.orderBy(F.col("geocoded_at").desc_nulls_last(), "address_id").limit(limit)


def recent_corrections(log: DataFrame, cache: DataFrame, limit: int = 100) -> DataFrame:
    return log.join(cache.select("address_id", "address", "city"), "address_id").orderBy(F.col("changed_at").desc_nulls_first(), F.col("id").desc()).limit(limit)

import dataclasses
import datetime

import pytest
from pyspark.sql import functions as F

from plotwright import fixtures, schemas, storage
from plotwright.operators import cache, dedup, fuzzy, geocode, impute, marts, profile, quality, quota, validate
from plotwright.operators.clean import clean
from plotwright.plans import prepare
from plotwright.session import DatabaseConfig, checked_identifier
from plotwright.sources import tables
from plotwright.sources.providers import Here, Offline, OpenStreetMap, Result

SMALL = "/root/testdata/sf0.001"
def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dedup_of_the_key(spark):
    df = spark.createDataFrame([(1, "P1", "1808 FOX CHASE DR", 240000, "2016-01-01", "L1"), (2, "P1", "1808 FOX CHASE DR", 240000, "2016-01-01", "L1"), (3, "P2", "410 ROSEHILL CT", 120000, "2016-02-01", "L2")], "unique_id int, parcel_id string, property_address string, sale_price int, sale_date string, legal_reference string")
    assert sorted(r.unique_id for r in dedup.keep_first(df, schemas.SALE_KEY, "unique_id").collect()) == [1, 3]
    assert tuple(dedup.excess(df, schemas.SALE_KEY).first()) == (1, 1)


def test_fill(spark):
    df = spark.createDataFrame([(1, "A", None, None, False), (2, "A", "X", "x", False), (3, "A", "Y", "x", False), (4, "B", None, None, False), (5, None, None, None, False), (6, None, "Z", None, False)], "unique_id int, parcel_id string, property_address string, owner_name string, flag boolean")
    got = {r.unique_id: (r.property_address, r.flag) for r in impute.fill(df, ["parcel_id"], "property_address", "flag").collect()}
    assert got == {1: ("X", True), 2: ("X", False), 3: ("Y", False), 4: (None, False), 5: (None, False), 6: ("Z", False)}
    two = {r.unique_id: r.property_address for r in impute.fill(df, ["parcel_id", "owner_name"], "property_address", "flag").collect()}
    assert two[1] is None


def test_spacing(spark):
    df = spark.createDataFrame([(1, "P", "10 ROSEHILL CT"), (2, "P", "12 ROSE HILL CT"), (3, "Q", "10 ROSEHILL CT"), (4, "P", None)], "unique_id long, parcel_id string, property_address string")
    got = {r.unique_id: r.property_address for r in fuzzy.correct_spacing(df).collect()}
    assert got == {1: "12 ROSE HILL CT", 2: "12 ROSE HILL CT", 3: "10 ROSEHILL CT", 4: None}


def test_match(spark):
    known = spark.createDataFrame([(1, "Fox Chase", "Dr"), (2, "Fox Chase Hill", None), (3, "Oak", None)], "address_id long, street_name string, street_suffix string")
    asked = spark.createDataFrame([("12 fox chase, x",), ("9 elm",), (None,)], "address string")
    got = fuzzy.match(asked, known, 0.7).collect()
    assert [(r.address, r.matched_address_id) for r in got] == [("12 fox chase, x", 1)]


def test_validation(spark):
    df = spark.createDataFrame([(1, "-5"), (1, "3")], "k int, price string")
    with pytest.raises(validate.ValidationError, match="price: 1 rows"):
        validate.require(df, {"price": F.col("price").startswith("-")})
    with pytest.raises(validate.ValidationError):
        validate.require_key(df, ["k"])
    child = spark.createDataFrame([(1,), (7,), (None,)], "r int")
    assert rows(validate.orphans(child, df, {"r": "k"})) == [(7,)]


def raw(spark, *changes):
    base = dict(zip(schemas.RAW_COLUMNS, ["1", "P1", "SINGLE", "1808  FOX CHASE DR, GOODLETTSVILLE", "April 9, 2013", "$240,000", "L1", "Yes", "OWN", None, "1.5", "D", "1", "2", "3", "1986", "3", "2", "0"], strict=True))
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], schemas.RAW)


def test_clean_sequence(spark):
    got = {r.unique_id: r for r in clean(raw(spark, {}, {"UniqueID": "2"}, {"UniqueID": "3", "PropertyAddress": None, "SalePrice": "5"}, {"UniqueID": "4", "ParcelID": "P2", "PropertyAddress": None, "OwnerAddress": "1 FALL CREEK DR, X, TN"})).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[3].property_address == "1808 FOX CHASE DR, GOODLETTSVILLE" and got[3].property_address_imputed
    assert got[4].property_address is None and not got[4].property_address_imputed
    assert got[1].sale_date == datetime.date(2013, 4, 9) and float(got[1].sale_price) == 240000 and got[1].sold_as_vacant and got[1].currency_code == "USD"
    with pytest.raises(validate.ValidationError, match="sale_price"):
        clean(raw(spark, {"SalePrice": "-1"}))
    with pytest.raises(validate.ValidationError, match="sold_as_vacant"):
        clean(raw(spark, {"SoldAsVacant": "maybe"}))
    with pytest.raises(validate.ValidationError, match="key"):
        clean(raw(spark, {}, {}))


def test_upsert_and_mappings(spark):
    sales = spark.createDataFrame([(1, "1 a st, Nash", None), (2, "1 A ST", "2 B RD, C, TN"), (3, " , X", "1 A ST, Antioch")], "unique_id long, property_address string, owner_address string")
    old = tables.add_columns(spark.createDataFrame([(7, "2 B RD", "OLD")], "address_id long, address string, city string"), schemas.ADDRESSES).select(*[f.name for f in schemas.ADDRESSES])
    got = cache.upsert(old, sales)
    assert rows(got.select("address_id", "address", "city")) == [(7, "2 B RD", "OLD"), (8, "1 A ST", "ANTIOCH")]
    again = cache.upsert(got, sales)
    assert again.count() == 2
    assert rows(cache.mappings(sales, got).select("mapping_id", "housing_id", "address_id", "address_type")) == [(1, 1, 8, "property"), (2, 2, 7, "owner"), (3, 2, 8, "property"), (4, 3, 8, "owner")]


def address_rows(spark, *given):
    have = spark.createDataFrame(list(given), "address_id long, address string, city string, latitude double, longitude double, corrected_address string")
    return tables.add_columns(have, schemas.ADDRESSES).select(*[f.name for f in schemas.ADDRESSES])


def test_geocode_chain_and_store(spark):
    known = address_rows(spark, (1, "1 A ST", "NASH", None, None, None), (2, "2 B", None, None, None, None), (3, "3 C", None, 36.0, -86.0, "c"))
    assert rows(geocode.pending(known)) == [(1, "1 A ST, NASH, TN"), (2, "2 B, TN")]
    make = lambda used: geocode.chain(Offline({"1 A ST, NASH, TN": (36.1, -86.8)}), Offline({"2 B, TN": (99.0, 0.0)}, name="HERE"), used)
    done, usage, report = geocode.bulk(known, known.select("address_id"), make, now(), batch_size=1)
    got = {r.address_id: r for r in done.collect()}
    assert got[1].geocode_status == "GEOCODED" and got[1].geom.lon == -86.8
    assert got[2].geocode_status == "FAILED" and got[2].geocode_source == "HERE" and got[2].geocoded_at is not None
    assert got[3].latitude == 36.0 and got[3].geocode_status is None
    assert {k: report[k] for k in ("asked", "geocoded", "failed", "stopped", "success_rate")} == {"asked": 2, "geocoded": 1, "failed": 1, "stopped": False, "success_rate": 0.5}
    assert report["seconds_per_address"] == report["seconds"] / 2 and usage.first().request_count == 1
    with pytest.raises(validate.ValidationError, match="repeated address_id"):
        geocode.store(known, spark.createDataFrame([(1, True, 36.0, -86.0, "a", 0.5, "OSM")] * 2, "address_id long, success boolean, latitude double, longitude double, corrected_address string, confidence double, source string"), now())


def test_quota_binds_across_batches_and_runs(spark):
    known = address_rows(spark, *[(k, f"{k} A ST", None, None, None, None) for k in range(1, 13)])
    places = {f"{k} A ST, TN": (36.0, -86.5) for k in range(1, 13)}
    clock = [datetime.datetime(2024, 1, 1, 20)]
    make = lambda used: geocode.chain(Offline({}), Offline(places, name="HERE"), used, 5)
    run = lambda rows, usage: geocode.bulk(rows, rows.select("address_id"), make, now(), usage, batch_size=3, cutoff=5, clock=lambda: clock[0])
    known, usage, report = run(known, None)
    assert report["stopped"] and report["asked"] == report["geocoded"] == 5 and known.where("latitude is not null").count() == 5
    assert quota.window_used(usage, "HERE", clock[0]) == (5, clock[0])
    clock[0] += datetime.timedelta(hours=20)  # the next day, within the window
    known, usage, report = run(known, usage)
    assert report["stopped"] and report["asked"] == 0 and known.where("latitude is not null").count() == 5
    clock[0] += datetime.timedelta(hours=4)  # its end
    known, usage, report = run(known, usage)
    assert report["geocoded"] == 5 and known.where("latitude is not null").count() == 10
    assert rows(usage.select("request_date", "request_count", "window_started_at")) == [(datetime.date(2024, 1, 1), 5, datetime.datetime(2024, 1, 1, 20)), (datetime.date(2024, 1, 2), 5, datetime.datetime(2024, 1, 2, 20))]


def test_published_quota_goes_on(spark, tmp_path):
    folder = str(tmp_path)
    known = address_rows(spark, *[(k, f"{k} A ST", None, None, None, None) for k in range(1, 7)])
    maps = spark.createDataFrame([(k, k, k, "property") for k in range(1, 6)], schemas.MAPPINGS)
    storage.Ledger(spark, folder).commit({"addresses": known, "mappings": maps})
    make = lambda used: geocode.chain(Offline({}), Offline({f"{k} A ST, TN": (36.0, -86.5) for k in range(1, 7)}, name="HERE"), used, 4)
    reports = [prepare.geocode_pending(spark, folder, make, batch_size=2, cutoff=4) for _ in range(2)]
    assert [r["geocoded"] for r in reports] == [4, 0] and all(r["stopped"] for r in reports)
    assert prepare.Store(spark, folder).read("addresses").where("latitude is not null").count() == 4
    assert "geocode_run" not in storage.Ledger(spark, folder).tables() and not list((tmp_path / "runs").glob("*"))


def test_killed_geocoding_run_goes_on(spark, tmp_path):
    """Killed after its second batch, then once more between the merge and its commit; no call is made twice and none is lost."""
    folder, calls = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    known = address_rows(spark, *[(k, f"{k} A ST", None, None, None, None) for k in range(1, 8)])
    maps = spark.createDataFrame([(k, k, k, "property") for k in range(1, 8)], schemas.MAPPINGS)
    storage.Ledger(spark, folder).commit({"addresses": known, "mappings": maps})
    places = {f"{k} A ST, TN": (36.0, -86.5) for k in range(1, 8)}

    @dataclasses.dataclass
    class Counted(Offline):
        def geocode(self, address):
            calls.add(1)
            return super().geocode(address)

    make = lambda used: geocode.chain(Offline({}), Counted(places, name="HERE"), used, 100)
    at = datetime.datetime(2024, 1, 1, 9)
    times = iter([at, at, None])

    def clock():
        if (now := next(times)) is None:
            raise KeyboardInterrupt
        return now

    with pytest.raises(KeyboardInterrupt):
        prepare.geocode_pending(spark, folder, make, batch_size=2, clock=clock)
    run = storage.Ledger(spark, folder).tables()["geocode_run"]
    log = sum(f.stat().st_size for f in (tmp_path / "store" / run).rglob("*.parquet"))
    assert calls.value == 4 and prepare.Store(spark, folder).read("addresses").where("latitude is not null").count() == 0

    real, storage.Ledger.place = storage.Ledger.place, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)
    try:
        with pytest.raises(KeyboardInterrupt):
            prepare.geocode_pending(spark, folder, make, batch_size=2, clock=lambda: at)
    finally:
        storage.Ledger.place = real
    assert calls.value == 7
    # What the log grew by are answers, of about the same size each.
    assert sum(f.stat().st_size for f in (tmp_path / "store" / run).rglob("*.parquet")) < 3 * log
    report = prepare.geocode_pending(spark, folder, make, batch_size=2, clock=lambda: at)
    store = prepare.Store(spark, folder)
    assert calls.value == 7 and report["asked"] == report["geocoded"] == 7
    assert store.read("addresses").where("latitude is not null").count() == 7
    assert rows(store.read("usage").select("api_name", "request_count", "window_started_at")) == [("HERE", 7, at)]
    assert prepare.geocode_pending(spark, folder, make, clock=lambda: at)["asked"] == 0 and calls.value == 7


def test_providers():
    found = b'[{"lat": "36.1", "lon": "-86.8", "display_name": "x", "importance": 0.4}]'
    osm = OpenStreetMap(get=lambda url, t: found if "countrycodes=us" in url else b"[]", interval=0)
    assert osm.geocode("a").success and osm.geocode("a").confidence == 0.4
    here = Here("k", get=lambda url, t: b'{"items": [{"position": {"lat": 36.1, "lng": -86.8}, "address": {"label": "y"}}]}', pause=0)
    assert here.geocode("a") == Result(True, 36.1, -86.8, "y", 0.5, "HERE", "GEOCODED", None, here.geocode("a").raw_response)
    assert not Here(None).geocode("a").success
    assert OpenStreetMap(get=lambda u, t: b"nonsense", interval=0).geocode("a").message


def test_corrections(spark):
    known = address_rows(spark, (1, "A", None, 36.0, -86.0, "old"), (2, "B", None, None, None, None))
    log = spark.createDataFrame([], schemas.CORRECTION_LOG)
    fix = lambda *r: spark.createDataFrame(list(r), "address_id long, corrected_address string, latitude double, longitude double, changed_by string, reason string")
    both, log2 = geocode.correct(known, fix((1, "new", 36.5, -86.0, "me", "r"), (9, "x", 1.0, 1.0, "me", "r")), log, now())
    assert rows(log2.select("id", "address_id", "field_changed", "original_value", "new_value")) == [(1, 1, "corrected_address", "old", "new"), (2, 1, "coordinates", "(36.0, -86.0)", "(36.5, -86.0)")]
    assert {r.address_id: r.geocode_status for r in both.collect()} == {1: "MANUALLY_CORRECTED", 2: None}
    assert geocode.correct(both, fix((2, "t", None, None, "me", "r")), log2, now())[1].count() == 3
    twice = [(1, "b", 36.2, -86.0, "me", "r"), (1, "a", 36.1, -86.0, "me", "r"), (None, "z", None, None, "me", "r")]
    with pytest.raises(validate.ValidationError, match="repeated address_id"):
        geocode.correct(known, fix(*twice), log, now())
    both, log2 = geocode.correct(known, fix(*twice), log, now(), order="latitude")
    assert both.count() == 2 and {r.address_id: (r.corrected_address, r.latitude) for r in both.collect()}[1] == ("b", 36.2)
    assert rows(log2.select("id", "original_value", "new_value")) == [(1, "old", "a"), (2, "(36.0, -86.0)", "(36.1, -86.0)"), (3, "a", "b"), (4, "(36.1, -86.0)", "(36.2, -86.0)")]


def test_quota(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    calls = spark.createDataFrame([("HERE", at(0)), ("HERE", at(20)), ("HERE", at(34)), ("OSM", None)], "api string, ts timestamp_ntz")
    assert rows(quota.windows(calls, "api", "ts")) == [("HERE", at(0), 2), ("HERE", at(34), 1)]
    usage = spark.createDataFrame([("HERE", at(0).date(), 5, at(0)), ("OSM", at(0).date(), 2, None), ("HERE", datetime.date(2023, 12, 30), 9, None)], "api_name string, request_date date, request_count long, window_started_at timestamp_ntz")
    found = quota.stats(usage, at(23))
    assert found["here_window_used"] == 5 and found["here_daily_remaining"] == 995 and found["here_resets_at"] == "2024-01-02 00:00" and found["today_usage"] == {"HERE": 5, "OSM": 2}
    assert quota.stats(usage, at(25))["here_resets_at"] is None


def test_quota_windows_of_many_keys_and_batches(spark):
    import random

    rng = random.Random(1)
    at = datetime.datetime(2024, 1, 1)
    calls = [(f"k{rng.randrange(5)}", at + datetime.timedelta(minutes=rng.randrange(9000))) for _ in range(3000)] + [(None, at)]
    want = []
    for key in {k for k, _ in calls}:
        started, n = None, 0
        for t in sorted(t for k, t in calls if k == key):
            if started is None or t >= started + datetime.timedelta(hours=24):
                want += [(key, started, n)] if started else []
                started, n = t, 0
            n += 1
        want.append((key, started, n))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        assert rows(quota.windows(spark.createDataFrame(calls, "api string, ts timestamp_ntz"), "api", "ts")) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for values in ([5.0], [1.0, 2.0], rng.integers(0, 50, 400).astype(float).tolist(), rng.normal(size=501).tolist()):
        df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double").repartition(3)
        got = profile.quantiles(df, "x", (0.0, 0.25, 0.5, 0.95, 1.0))
        assert got == pytest.approx(np.quantile(values, (0.0, 0.25, 0.5, 0.95, 1.0)).tolist())
    assert profile.quantiles(spark.createDataFrame([(None,)], "x double"), "x", (0.5,)) == [None]
    empty = spark.createDataFrame([], "x double")
    assert profile.outliers(empty, "x").count() == 0 and profile.numeric_summary(empty).first().q50 is None and marts.price_breaks(empty, "x").count() == 1


def test_polled_stream(spark, tmp_path):
    from plotwright.streaming.quota import polled, stream_windows

    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    put = lambda *hours: spark.createDataFrame([("HERE", at(h)) for h in hours], "api string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen: dict = {}
    put(0, 1)
    stream = stream_windows(spark.readStream.schema("api string, ts timestamp_ntz").parquet(f"{tmp_path}/in"), "api", "ts")
    query = polled(stream, lambda df, k: seen.update({str(r.window_started_at): r.request_count for r in df.collect()}), f"{tmp_path}/state", "1 second")
    try:
        query.processAllAvailable()
        assert seen == {"2024-01-01 00:00:00": 2}
        put(20, 30, 31)  # one more of the open window, then the next
        query.processAllAvailable()
        assert seen == {"2024-01-01 00:00:00": 3, "2024-01-02 06:00:00": 2}
        put(29)  # late: counts to the open window
        query.processAllAvailable()
        assert seen == {"2024-01-01 00:00:00": 3, "2024-01-02 06:00:00": 3}
    finally:
        query.stop()


def test_impute_from_snapshot(spark, tmp_path):
    given = raw(spark, {}, {"UniqueID": "2", "PropertyAddress": None, "SalePrice": "5"}, {"UniqueID": "3", "ParcelID": "P9", "PropertyAddress": None})
    tables.write_csv(given, f"{tmp_path}/snapshot")
    clean(given).write.parquet(f"{tmp_path}/sales")
    found = prepare.impute_from_snapshot(spark, f"{tmp_path}/snapshot", str(tmp_path)).first()
    assert found.property_address_imputed == 1 and found.property_address_missing == 1
    assert tables.read_snapshot(spark, f"{tmp_path}/snapshot").schema == schemas.SNAPSHOT
    assert tables.read_csv(spark, f"{tmp_path}/snapshot", multi_line=False).count() == 3


def test_references_are_checked_and_tables_kept(spark, tmp_path):
    tables.write_csv(raw(spark, {}, {"UniqueID": "2", "ParcelID": "P2"}), f"{tmp_path}/raw.csv")
    prepare.prepare(spark, f"{tmp_path}/raw.csv", f"{tmp_path}/store", keep_tables=True)
    assert storage.exists(spark, f"{tmp_path}/store/raw")
    maps = prepare.Store(spark, f"{tmp_path}/store").read("mappings")
    with pytest.raises(validate.ValidationError, match="reference"):
        validate.require_reference(maps, maps.select("housing_id").limit(0), {"housing_id": "housing_id"})


def test_cached_reads_are_renewed(spark, tmp_path):
    clock = [0.0]
    cached = prepare.Cached(prepare.Store(spark, str(tmp_path)), 600, lambda: clock[0])
    storage.publish(spark.range(3), f"{tmp_path}/sales")
    first = cached.read("sales")
    assert first.count() == 3 and first.is_cached
    storage.publish(spark.range(5), f"{tmp_path}/sales")
    clock[0] = 599
    assert cached.read("sales") is first and cached.read("sales").count() == 3
    clock[0] = 600
    assert cached.read("sales").count() == 5 and not first.is_cached


def test_catalogue(spark):
    assert tables.ensure_database(spark, "plots_test") and not tables.ensure_database(spark, "plots_test")
    assert tables.missing_tables(spark, ["plots_test.nothing"]) == ["plots_test.nothing"]
    spark.sql("DROP DATABASE plots_test")
    found = tables.columns_of(spark.range(1)).first()
    assert tuple(found) == (1, "id", "bigint", False)


def test_quality(spark):
    sales = spark.createDataFrame([(1, "0 10TH AVE N"), (2, "0"), (3, "10 X ST"), (4, None)], "unique_id long, property_address string")
    none = spark.createDataFrame([], schemas.ISSUES)
    new = quality.placeholder_issues(sales, none)
    assert rows(new.select("unique_id")) == [(1,), (2,)]
    assert quality.placeholder_issues(sales, new).count() == 0


def test_profile_edges(spark):
    empty = spark.createDataFrame([], "a double, b string, sale_date string")
    got = {r.column_name: r for r in profile.columns(empty).collect()}
    assert got["a"].missing == 0 and got["a"].missing_pct is None
    assert profile.missing_blocks(empty).count() == 0
    df = spark.createDataFrame([(None, None, "x", 1), (None, None, "", 2), (1.0, "q", "2013-01-01", 3)], "a double, b string, sale_date string, k int")
    got = {r.column_name: r for r in profile.columns(df).collect()}
    assert got["sale_date"].date_format_issues == 2 and got["sale_date"].empty_strings == 1
    assert [(r.columns, r.rows_missing_all, r.pct) for r in profile.missing_blocks(df).collect()] == [(["a", "b"], 2, 66.7)]
    assert rows(profile.missing_correlation(df.select("a", "k"))) == [("a", "a", pytest.approx(1.0))]


def test_marts(spark):
    breaks = marts.price_breaks(spark.createDataFrame([(float(x),) for x in (1000, 1000, 1001)], "sale_price double")).first()[0]
    assert breaks == [1000.0, 1000.0, 1000.5]
    assert marts.status(spark.createDataFrame([], schemas.ADDRESSES)).first().geocoded_percentage is None


def test_bom_and_csv(spark, tmp_path):
    for data in (b"\xef\xbb\xbfowner,citt\xc3\xa0\r\nJos\xc3\xa9,Franklin\r\n", b"a,b\n1,2\n"):
        (tmp_path / "in.csv").write_bytes(data)
        assert tables.strip_bom(str(tmp_path / "in.csv"), str(tmp_path / "out.csv")) is data.startswith(tables.BOM)
        assert (tmp_path / "out.csv").read_bytes() == data.removeprefix(tables.BOM)
    (tmp_path / "x.csv").write_bytes(b'\xef\xbb\xbfa,b\n1,"x, ""y"""\n2,\n')
    assert rows(tables.read_csv(spark, str(tmp_path / "x.csv"), schemas.fields("a string, b string"))) == [("1", 'x, "y"'), ("2", None)]


def test_config():
    assert DatabaseConfig.from_env({}) == DatabaseConfig()
    c = DatabaseConfig.from_env({"DB_HOST": "h", "DB_PORT": "1", "DB_NAME": "n", "DB_USER": "u", "DB_PASSWORD": "p@ss/word%:#?&"})
    assert c.password == "p@ss/word%:#?&" and "p%40ss%2Fword%25%3A%23%3F%26" in c.url()
    with pytest.raises(ValueError):
        DatabaseConfig().url()
    with pytest.raises(ValueError):
        checked_identifier("a; drop")


def test_whole_run(spark, tmp_path):
    text = fixtures.read(spark, SMALL, fixtures.RAW)
    source, folder = str(tmp_path / "raw"), str(tmp_path / "store")
    tables.write_csv(text, source)
    made = prepare.prepare(spark, source, folder)
    assert made["sales"] > 1000 and made["addresses"] > 10 and made["mappings"] > 1000
    assert not storage.exists(spark, f"{folder}/raw")
    assert prepare.prepare(spark, source, folder) == made
    over = prepare.maintain(spark, folder).first()
    assert over.duplicate_groups == 0 and over.sales == made["sales"]
    prepare.export(spark, folder, str(tmp_path / "out"))
    full, public = (spark.read.csv(str(tmp_path / "out" / x), header=True) for x in ("full", "public"))
    assert full.count() == made["sales"] and full.columns == schemas.EXPORTED
    assert set(validate.export_invariants(full, public, schemas.OWNER_COLUMNS)) <= {"property_address"}
    assert b"\r\n" in next((tmp_path / "out" / "full").glob("part-*")).read_bytes()

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright import catalog, fixtures
from plotwright.functions import spatial as tiles
from plotwright.operators import marts, procedures, profile, selection
from plotwright.schemas import EXPORT_COLUMNS
from plotwright.sources import exports, lookups, spatial, tables
from plotwright.sources.providers import ByRule, Result

SMALL = "/root/testdata/sf0.001"


# --- quantiles and profiles ---------------------------------------------------------------------


def jobs(spark, run):
    """How many Spark jobs ``run`` starts."""
    context = spark.sparkContext
    before = context._jsc.sc().dagScheduler().numTotalJobs()
    run()
    return context._jsc.sc().dagScheduler().numTotalJobs() - before


@pytest.mark.parametrize("few", [100_000, 3])
def test_quantiles_of_many_groups(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", 8)
    rng = np.random.default_rng(1)
    shapes = [rng.normal(size=300), np.exp(rng.normal(size=200) * 40), np.repeat([1.0, 2.0, 5e-324, -5e-324], 50), np.array([3.0]), np.array([-1.7e308, 1.7e308, 0.0, 1.0]), np.array([-0.0, 0.0, 1.0]), np.array([np.inf, -np.inf, 1.0, 2.0, 3.0]), rng.integers(0, 4, 500).astype(float)]
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    rows = [(g, float(x)) for g, xs in enumerate(shapes) for x in xs] + [(0, None), (9, None), (10, float("nan")), (10, 1.0)]
    got = selection.quantiles_by_group(spark.createDataFrame(rows, "g int, x double").withColumn("n", F.lit(1).cast("long")), shares)
    for g, xs in enumerate(shapes):
        if np.isfinite(xs).all():
            want = np.sort(xs)
            for q, s in zip(got[g], shares, strict=True):
                place = s * (len(want) - 1)
                low = want[int(place)]
                expected = low + (place - int(place)) * (want[int(place) + 1] - low) if place > int(place) else low
                assert q == expected or math.isclose(q, expected, rel_tol=1e-12), (g, s)
    assert got[6][0] == -math.inf and got[6][2] == 2.0 and got[6][4] == math.inf
    assert 9 not in got and got[10][0] == 1.0 and math.isnan(got[10][4])


def test_weights_count_as_rows(spark):
    rows = spark.createDataFrame([(0, 1.0, 3), (0, 2.0, 1), (0, 9.0, 4)], "g int, x double, n long")
    assert selection.quantiles_by_group(rows, (0.25, 0.5, 0.75))[0] == [1.0, 5.5, 9.0]


def test_jobs_do_not_grow_with_columns(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(200, 12))], ", ".join(f"c{k} double" for k in range(12))).cache()
    df.count()
    one, all_ = (jobs(spark, lambda n=n: profile.numeric_summary(df, [f"c{k}" for k in range(n)]).collect()) for n in (1, 12))
    assert one == all_


def test_profile_is_one_scan(spark):
    plan = profile.columns(spark.read.parquet(f"{SMALL}/orders.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan parquet") == 1


def test_distinct_numbers_by_bitmaps(spark):
    rng = random.Random(9)
    rows = [(rng.randint(-70_000, 70_000), rng.randint(-(2**62), 2**62), None, 7, k % 40_000 - 5) for k in range(5000)] + [(None, None, None, None, None), (0, -(2**63), None, 7, 2**31 - 1)]
    df = spark.createDataFrame(rows, "dense long, sparse long, gone long, one int, mixed int")
    got = {r.column_name: r.unique_values for r in profile.distinct_counts(df).collect()}
    assert got == {c: len({r[k] for r in rows} - {None}) for k, c in enumerate(df.columns)}
    plan = profile.distinct_counts(df.select("dense"))._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan
    assert {r.unique_values for r in profile.distinct_counts(df.limit(0)).collect()} == {0} and profile.distinct_counts(df.select(F.lit("x").alias("t"))).count() == 0


def test_profile_values(spark):
    long_text = "x" * 500
    rows = [(1, 0.5, "a", "2020-01-01", "1 A ST", [1], None), (2, -0.0, "", "bad", "A ST", [1], None), (2**60 + 1, 0.0, long_text, None, None, None, None), (2**60, float("nan"), long_text + "y", "", "5", [2], None)]
    df = spark.createDataFrame(rows, "i long, f double, t string, sale_date string, address string, a array<int>, gone int")
    got = {r.column_name: r for r in profile.columns(df).collect()}
    assert [got[c].unique_values for c in ("i", "f", "t", "sale_date", "address", "a", "gone")] == [4, 3, 4, 3, 3, 2, 0]
    assert got["f"].zeros == 2 and got["f"].negatives == 0 and got["i"].empty_strings is None and got["t"].empty_strings == 1
    assert got["sale_date"].date_format_issues == 2 and got["address"].no_house_number == 1 and got["t"].date_format_issues is None
    assert got["gone"].missing == 4 and got["gone"].mean is None and got["gone"].zeros == 0 and got["t"].zeros is None
    empty = {r.column_name: r for r in profile.columns(df.limit(0)).collect()}
    assert len(empty) == 7 and empty["i"].missing == 0 and empty["i"].missing_pct is None


# --- tiles --------------------------------------------------------------------------------------


def test_tiles_match_bit_by_bit(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (95.0, 200.0)]
    df = spark.createDataFrame([*points, (None, 1.0)], "lat double, lng double")
    for zoom in (1, 7, tiles.FINEST):
        want = [tiles.number(tiles.place(b, -180, 360, zoom), tiles.place(a, -90, 180, zoom)) for a, b in points]
        assert [r[0] for r in df.select(tiles.tile(F.col("lat"), F.col("lng"), zoom)).collect()] == [*want, None]


@pytest.mark.parametrize("most", [1, 4, 64, 500])
def test_cover_holds_the_box(most):
    rng = random.Random(most)
    for _ in range(50):
        lat, lng = (sorted((rng.uniform(-90, 90), rng.uniform(-180, 180))) for _ in range(2))
        lat, lng = sorted(rng.uniform(-90, 90) for _ in range(2)), sorted(rng.uniform(-180, 180) for _ in range(2))
        ranges = tiles.cover(tuple(lat), tuple(lng), most, zoom=10)
        assert len(ranges) <= most and all(a <= b for a, b in ranges) and ranges == sorted(ranges)
        for _ in range(20):
            a, b = rng.uniform(*lat), rng.uniform(*lng)
            n = tiles.number(tiles.place(b, -180, 360, 10), tiles.place(a, -90, 180, 10))
            assert any(x <= n <= y for x, y in ranges)


def placed(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.uniform(34, 38), rng.uniform(-89, -84), float(rng.randint(1, 40)) * 10_000) for k in range(n)] + [(n + k, 36.1, -86.7, 5.0) for k in range(n)] + [(-1, None, 1.0, 2.0)]
    return spark.createDataFrame(rows, "id long, latitude double, longitude double, sale_price double")


def test_box_reads_few_files(spark, tmp_path):
    df = placed(spark)
    spatial.publish(df, f"{tmp_path}/t", files=40)
    total = len(list((tmp_path / "t/rows").glob("*.parquet")))
    box = ((35.0, 35.3), (-87.0, -86.6))
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    got = spatial.in_box(spark, f"{tmp_path}/t", *box)
    want = df.where(F.col("latitude").between(*box[0]) & F.col("longitude").between(*box[1]))
    assert sorted(got.collect()) == sorted(want.collect()) and got.columns == df.columns
    assert total >= 30 and len(got.inputFiles()) <= total // 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(tile_" in pushed and "LessThanOrEqual(tile_" in pushed
    assert spatial.in_box(spark, f"{tmp_path}/t", (10.0, 11.0), (10.0, 11.0)).count() == 0
    # Half of all rows share one place; files are of like size all the same.
    sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/t/files").collect()]
    assert sum(sizes) == df.count() and max(sizes) <= 4 * (df.count() / total)
    spatial.publish(df.limit(5), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/rows").count() == 5
    spatial.publish(df.limit(0), f"{tmp_path}/e")
    assert spatial.in_box(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_pyramid_medians_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "FEW", 10)
    df = placed(spark, 800)
    got = {(r.zoom, r.tile): (r.n, r.median_price, r.price_bucket) for r in marts.pyramid(df, range(0, 9, 2), F.array(F.lit(6.0), F.lit(200_000.0)), most=most).collect()}
    want: dict = {}
    for r in df.where("latitude is not null").collect():
        for z in range(0, 9, 2):
            key = z, tiles.number(tiles.place(r.longitude, -180, 360, 8) >> 8 - z, tiles.place(r.latitude, -90, 180, 8) >> 8 - z)
            want.setdefault(key, []).append(r.sale_price)
    assert got == {k: (len(v), float(np.median(v)), int(np.median(v) >= 6) + int(np.median(v) >= 200_000)) for k, v in want.items()}


# --- exports ------------------------------------------------------------------------------------


def test_bucketed_export_shuffles_nothing(spark, tmp_path):
    sales = catalog.whole_sales(spark, SMALL)
    maps, known = fixtures.view(spark, SMALL, "mappings"), fixtures.view(spark, SMALL, "addresses")
    marts.publish_bucketed(sales, maps, known, "bucketed_test", str(tmp_path), 4)
    out = marts.export_bucketed(spark, "bucketed_test")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.split("Initial Plan")[-1].count("SortMergeJoin") == 2
    assert sorted(map(str, out.collect())) == sorted(map(str, marts.export_rows(sales, maps, known, EXPORT_COLUMNS).select(out.columns).collect()))


def files(at):
    return sorted(str(p.relative_to(at)) for p in at.rglob("*.csv"))


def test_both_exports_or_neither(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).selectExpr("id AS unique_id", "concat('a \"', id, '\", b') AS t", "id % 2 = 0 AS b", "cast(null AS double) AS owner_latitude")
    at = tmp_path / "out"
    read = spark.sparkContext.accumulator(0)
    seen = df.mapInPandas(lambda batches: (read.add(len(b)) or b for b in batches), df.schema)
    exports.export(seen, str(at), ["t"], single=True)
    full, public = (spark.read.csv(f"{at}/{k}", header=True, escape='"').collect() for k in ("full", "public"))
    assert [r.unique_id for r in full] == [str(k) for k in range(100)] == [r.unique_id for r in public]
    assert full[3].t == 'a "3", b' and full[3].b == "f" and all(r.t is None for r in public) and len(files(at)) == 2
    assert read.value == 100  # computed once for both
    before = files(at)
    # A task that fails leaves what was there, and nothing else.
    broken = df.withColumn("t", F.when(F.col("unique_id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        exports.export(broken, str(at), ["t"], single=False)
    assert files(at) == before and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="lost"):
        exports.export(broken, str(tmp_path / "new"), ["t"], single=False)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    exports.export(df.limit(0), str(at), ["t"])
    assert spark.read.csv(f"{at}/full", header=True).count() == 0


def test_a_retried_task_counts_once(spark, tmp_path):
    writer = exports.TwoWriter(str(tmp_path / "o"), ["a", "b"], ["b"], True)

    class Context:
        partitionId = staticmethod(lambda: 3)

    import unittest.mock as mock

    with mock.patch.object(exports.TaskContext, "get", return_value=Context):
        writer.write(iter([("1", "x")]))  # an attempt that was lost before its commit
        done = writer.write(iter([("1", "x"), ("2", None)]))
    writer.commit([done, None])
    assert len(files(tmp_path / "o")) == 2
    assert next((tmp_path / "o/full").glob("*")).read_bytes() == b"a,b\r\n1,x\r\n2,\r\n" and next((tmp_path / "o/public").glob("*")).read_bytes() == b"a,b\r\n1,\r\n2,\r\n"


# --- lookups ------------------------------------------------------------------------------------


class Fake:
    """A clock of its own for each partition, begun at different times."""

    def __init__(self, at):
        self.at, self.waits = at, []

    def now(self):
        return self.at

    def sleep(self, s):
        self.at += s


def test_requests_of_all_partitions_keep_the_rate():
    rng = random.Random(1)
    for parts, interval in ((1, 1.1), (4, 1.1), (7, 0.25)):
        asked = []
        for k in range(parts):
            fake = Fake(1000.0 + rng.random() * 5)
            pace = lookups.slots(k, parts, interval, 1000.0, lookups.Clock(fake.now, fake.sleep))
            for _ in range(30):
                pace()
                asked.append(fake.at)
                fake.at += rng.choice([0, 0.01, 3 * interval])
        asked.sort()
        assert min(b - a for a, b in zip(asked, asked[1:], strict=False)) >= interval - 1e-6


def test_the_quota_is_spent_to_the_call(spark):
    part = spark.createDataFrame([(k, f"{k} A ST") for k in range(40)], "address_id long, full_address string")
    none, all_ = ByRule(lambda a: None), ByRule(lambda a: (36.0, -86.5), name="HERE")
    idle = lookups.Clock(lambda: 0.0, lambda s: None)
    for left in (0, 1, 13, 39, 40, 100):
        got = lookups.answers(part, none, all_, left, parts=6, interval=1.0, clock=idle)
        by = {r.address_id: r for r in got.collect()}
        assert len(by) == got.count() == 40 and sum(r.source == "HERE" and r.success for r in by.values()) == min(left, 40)
        assert sum(r.message == lookups.USED_UP for r in by.values()) == max(0, 40 - left)


def test_shares_left_over_are_dealt_again(spark):
    part = spark.createDataFrame([(k, f"{k} A ST") for k in range(20)], "address_id long, full_address string")
    first = ByRule(lambda a: None if int(a.split()[0]) % 4 == 0 else (36.0, -86.5))  # one partition needs the second provider only
    got = lookups.answers(part, first, ByRule(lambda a: (36.0, -86.5), name="HERE"), 5, parts=4, interval=0.0)
    assert got.where("source = 'HERE' and success").count() == 5 and got.where("success").count() == 20


def test_lookups_are_a_source(spark):
    spark.dataSource.register(lookups.Lookups)
    plan = lookups.Plan(lambda share, pace: lambda a: Result(True, 36.0, -86.0, a, float(share), "OSM", "GEOCODED"), 0.0, lookups.Clock())
    import base64

    from pyspark import cloudpickle

    options = {"asked": json.dumps([[1, "a"], [2, "b"], [3, "c"]]), "plan": base64.b64encode(cloudpickle.dumps(plan)).decode(), "parts": "2", "quota": "5", "start": "0"}
    df = spark.read.format("lookups").options(**options).load()
    assert df.rdd.getNumPartitions() == 2 and sorted((r.address_id, r.confidence) for r in df.collect()) == [(1, 3.0), (2, 2.0), (3, 3.0)]


# --- scripts ------------------------------------------------------------------------------------


def test_script_refuses_what_is_no_name(spark):
    spark.createDataFrame([(1, "P", None), (2, "P", "it's")], "unique_id long, parcel_id string, a string").createOrReplaceTempView("t_in")
    assert sorted((r.unique_id, r.a, r.flag) for r in procedures.impute(spark, "t_in", "t_in", ["parcel_id"], "a", "t.parcel_id = 'P'", "flag").collect()) == [(1, "it's", True), (2, "it's", False)]
    for bad in ("a; drop", "a`b", "a'", ""):
        with pytest.raises(ValueError):
            procedures.impute(spark, "t_in", "t_in", ["parcel_id"], bad)
        with pytest.raises(ValueError):
            procedures.impute(spark, bad, "t_in", ["parcel_id"], "a")


def test_script_leaves_rows_to_executors(spark):
    spark.range(1000).selectExpr("id as unique_id", "'P' as parcel_id", "if(id > 0, null, 'a') as a").createOrReplaceTempView("t_many")
    made = []
    assert jobs(spark, lambda: made.append(procedures.impute(spark, "t_many", "t_many", ["parcel_id"], "a"))) == 0
    assert "LocalRelation" not in made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert made[0].where("a = 'a'").count() == 1000
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("imputed_")]


# --- files in pieces ----------------------------------------------------------------------------


def test_large_csv_is_split_unless_fields_span_lines(spark, tmp_path):
    texts = ["plain", 'x, "y"', '5" pipe', "", '"', '""', " ", "a\tb"]
    flat = [f'{k},"{t.replace(chr(34), chr(34) * 2)}"' if k % 2 or "," in t or t.startswith('"') else f"{k},{t}" for k, t in enumerate(texts * 2000)]
    cases = {"flat": flat, "spanning": [*flat, '99999,"two\r\nlines"'], "stray": [*flat, '1,x",y,"z\r\nw"'], "lone": [*flat, '3,"a\rb"'], "blank": [*flat, "  "]}
    schema = "a string, b string"
    for name, body in cases.items():
        (tmp_path / f"{name}.csv").write_bytes(b"\xef\xbb\xbf" + "".join(x + "\r\n" for x in ["a,b", *body]).encode())
    whole = {name: sorted(map(str, tables.read_csv(spark, f"{tmp_path}/{name}.csv", schema).collect())) for name in cases}
    assert len(whole["flat"]) == len(flat) and any("two" in r and "lines" in r for r in whole["spanning"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        for name in cases:
            read = tables.read_csv(spark, f"{tmp_path}/{name}.csv", schema)
            assert (read.rdd.getNumPartitions() > 4) == (name == "flat")
            assert sorted(map(str, read.collect())) == whole[name]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", ["csv_bom_load", "csv_round_trip"])
def test_csv_queries_write_more_than_one_file(spark, monkeypatch, name):
    seen = []
    plain = tables.write_csv
    monkeypatch.setattr(tables, "write_csv", lambda df, path, **how: (plain(df, path, **how), seen.append(spark.read.text(path).inputFiles())))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        catalog.QUERIES[name](spark, SMALL).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [len(files) for files in seen] == [4]


def test_export_lines_are_those_of_the_row_writer(spark, tmp_path):
    cells = ["", "a", 'a"b', "a,b", "a\nb", "a\rb", " a ", '"', None]
    rows = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in cells for y in cells)]
    df = spark.createDataFrame(rows, "unique_id long, t string, u string")
    exports.export(df, str(tmp_path / "o"), ["u"])
    line = exports.TwoWriter.line
    for kind, hide in (("full", False), ("public", True)):
        want = line(df.columns) + "".join(line([str(k), x or "", "" if hide else y or ""]) for k, x, y in rows)
        assert next((tmp_path / "o" / kind).glob("*")).read_bytes() == want.encode()
    one = exports.lines(df.select("t"), ["t"]).collect()
    assert [r.full for r in one] == [line([x or ""]) for _, x, _ in rows] and all(r.public == line([""]) for r in one)
    assert isinstance(exports.TwoExports({"path": "p", "names": "[]"}).writer(df.schema, True), exports.DataSourceArrowWriter)


def test_blanks_are_collapsed_where_there_are_any(spark):
    from plotwright.operators.clean import collapse

    out = collapse(spark.createDataFrame([("a  b   c",), ("a b",), ("   ",), ("",), (None,)], "t string"))
    assert [r.t for r in out.collect()] == ["a b c", "a b", " ", "", None]
    assert "CASE WHEN" in out._jdf.queryExecution().analyzed().toString()  # the pattern is met by those texts only

import math

import pytest
from pyspark.sql import functions as F

from plotwright.functions import address as A
from plotwright.functions import text as X
from plotwright.functions import values as V


def one(spark, expression, *values, types=None):
    names = [f"c{k}" for k in range(len(values))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(values), strict=True))
    return spark.createDataFrame([tuple(values)], schema).select(expression(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("12 fox rd, franklin", "12 FOX ROAD, FRANKLIN"), ("12 FOX RD", "12 FOX ROAD"), ("1 N N X", "1 NORTH N X"), ("5 N MAIN ST", "5 NORTH MAIN STREET"), ("7  A  PKWY ", "7 A PARKWAY"), ("N MAIN", "N MAIN"), ("1 ST\n", "1 ST"), (None, None), ("", "")],
)
def test_standardize(spark, given, wanted):
    assert one(spark, A.standardize_abbreviations, given) == wanted


def test_sql_functions(spark):
    A.register_sql(spark)
    row = spark.sql("SELECT p.* FROM VALUES ('12-14 fox rd, Franklin, TN') t(a), LATERAL parse_address_components(a) p").first()
    assert tuple(row) == ("12-14", "fox rd", "Franklin", "12-14 FOX ROAD, FRANKLIN, TN")
    assert spark.sql("SELECT clean_all('1 A 2', r'[0-9]+')").first()[0] == "A"


def test_components(spark):
    assert one(spark, A.house_number, "12-14 FOX RD") == "12-14"
    assert one(spark, A.house_number, "FOX RD") is None
    assert one(spark, A.city, "1 A ST, FRANKLIN, TN") == "FRANKLIN"
    assert one(spark, A.city, "1 A ST") is None
    assert one(spark, A.street_name, "12 FOX RD, X") == "FOX RD"
    assert one(spark, A.street_key, " 1 a st , b") == "1 A ST"
    assert one(spark, A.street_key, " , b") is None


@pytest.mark.parametrize(("given", "bad", "price"), [("$1,234.50", False, 1234.5), ("240000", False, 240000), ("-5", True, 5), ("", True, None), (None, None, None), ("USD 5", True, 5)])
def test_price(spark, given, bad, price):
    assert one(spark, V.bad_price, given) is bad
    got = one(spark, V.parse_price, given)
    assert (None if got is None else float(got)) == price


@pytest.mark.parametrize(("given", "wanted"), [("April 9, 2013", "2013-04-09"), ("4/9/2013", "2013-04-09"), ("2013-04-09", "2013-04-09"), ("2013-04-09 00:00:00", "2013-04-09"), ("never", None)])
def test_dates(spark, given, wanted):
    assert one(spark, lambda c: V.parse_date(c).cast("string"), given) == wanted


@pytest.mark.parametrize(("value", "wanted"), [(0.0, 0.0), (12345.0, 12000.0), (987.0, 990.0), (-3.0, 0.0), (0.0123, 0.012), (125.0, 120.0)])
def test_nice_round(spark, value, wanted):
    assert math.isclose(one(spark, V.nice_round, value, types=["double"]), wanted, abs_tol=1e-12)


def test_bucket_goes_up_at_a_break(spark):
    f = lambda c: V.bucket(c, F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)))
    assert [one(spark, f, x, types=["double"]) for x in (5.0, 10.0, 29.9, 30.0, None)] == [0, 1, 2, 3, None]


def test_bounds(spark):
    f = lambda a, b: V.in_bounds(a, b)
    assert [one(spark, f, a, b, types=["double", "double"]) for a, b in ((35.0, -87.6), (36.7, -85.7), (36.71, -86.0), (None, -86.0))] == [True, True, False, None]


def test_csv_value(spark):
    cell = lambda v, t: one(spark, lambda c: X.csv_value(c, t), v, types=[t])
    assert [cell(True, "boolean"), cell(False, "boolean"), cell(None, "boolean")] == ["t", "f", ""]
    assert [cell(x, "double") for x in (15000000.0, 1.5, 0.0, 36.123456789, -2.25e-3, None)] == ["15000000.0", "1.5", "0.0", "36.123456789", "-0.00225", ""]
    assert cell("a, b", "string") == "a, b"


def test_text_helpers(spark):
    assert one(spark, lambda c: X.count_substring(c, "ab"), "abcab") == 4
    assert one(spark, X.mentions_tennessee, "x, tn") is True
    assert one(spark, X.mentions_tennessee, "TNT") is False
    assert one(spark, X.full_address, "1 A", "B") == "1 A, B, TN"
    assert one(spark, X.full_address, "1 A, TN", None) == "1 A, TN"
    assert one(spark, X.normalize_state, None) == "TN"
    assert one(spark, X.percent_label, 1, 0, types=["long", "long"]) == "1 (0.0%)"
    assert one(spark, X.confidence_label, None, types=["double"]) == "N/A"
    assert X.snake_case("UniqueID") == "unique_id" and X.snake_case("ParcelID") == "parcel_id"
    assert [X.snake_case_loose(c) for c in ("UniqueID", "Unnamed: 0", "Full/Half Bath #", "suite/ condo   #")] == ["uniqueid", "unique_id", "full_or_half_bath", "suite_or_condo"]
    assert X.columns_except(["a", "b", "c"], ["a", "c"]) == ["b"]

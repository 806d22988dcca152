"""Profiles and quality measures, by aggregates; only rows of the size of the schema, and the parts of histograms, reach the driver."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.functions.values import parse_date
from plotwright.operators.selection import quantiles_by_group
from plotwright.storage import settle

STATS = ["missing", "missing_pct", "unique_values", "unique_pct", "min", "max", "mean", "zeros", "negatives", "empty_strings", "date_format_issues", "no_house_number"]


def numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


#: A text of more characters stands for itself by its SHA-256 where values are counted.
LONG = 64


def values(df: DataFrame) -> DataFrame:
    """(col, gone, text, num, bad_date, no_digit, n): how often each column has each value, from one pass over ``df``.

    ``col`` numbers the columns, ``gone`` marks nulls. Numbers are themselves in ``num``, and whole or decimal ones also text, as not all fit a double.
    """
    flag = F.lit(None).cast("boolean")
    cells = []
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(c)
        else:
            text = F.lit(None).cast("string") if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType) else c.cast("string")
        is_text, name = isinstance(f.dataType, T.StringType), f.name.lower()
        cells.append(
            F.struct(
                F.lit(k).alias("col"),
                c.isNull().alias("gone"),
                F.when(F.length(text) > LONG, F.concat(F.lit("#"), F.sha2(F.encode(text, "UTF-8"), 256))).otherwise(text).alias("text"),
                (c.cast("double") if numeric(f) else F.lit(None).cast("double")).alias("num"),
                (c.isNotNull() & parse_date(c).isNull() if is_text and "date" in name else flag).alias("bad_date"),
                (~c.rlike(r"\d") if is_text and "address" in name else flag).alias("no_digit"),
            )
        )
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("col", "gone", "text", "num", "bad_date", "no_digit").agg(F.count("*").alias("n"))


def columns(df: DataFrame) -> DataFrame:
    """One row per column, all from one pass, by the counts of different values: missing and distinct values; of numbers also range, mean, zeros and negatives; of text also empty strings, dates that cannot be read (columns named date) and addresses without a digit (columns named address)."""
    spark = df.sparkSession
    rows = [(k, f.name, f.dataType.simpleString(), numeric(f), isinstance(f.dataType, T.StringType)) for k, f in enumerate(df.schema)]
    fields = spark.createDataFrame(rows, "col_ int, column_name string, data_type string, number boolean, text_ boolean")
    n, num = F.col("n"), F.col("num")
    sum_if = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    present = ~F.col("gone")
    by = values(df).groupBy("col").agg(
        F.sum("n").alias("rows"),
        sum_if(F.col("gone")).alias("missing"),
        F.count_if(present).alias("unique_values"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        (F.sum(num * n) / F.nullif(F.sum(F.when(num.isNotNull(), n)), F.lit(0))).alias("mean"),
        sum_if(num == 0).alias("zeros"),
        sum_if(num < 0).alias("negatives"),
        sum_if(F.col("text") == "").alias("empty_strings"),
        F.sum(F.when(F.col("bad_date"), n).when(F.col("bad_date").isNotNull(), 0)).alias("date_format_issues"),
        F.sum(F.when(F.col("no_digit"), n).when(F.col("col").isNotNull() & F.col("no_digit").isNotNull(), 0)).alias("no_house_number"),
    )
    joined = fields.join(by, F.col("col_") == F.col("col"), "left")
    zero = lambda c, cond=None: F.coalesce(c, F.lit(0)) if cond is None else F.when(F.col(cond), F.coalesce(c, F.lit(0)))
    share = lambda c: 100.0 * zero(F.col(c)) / F.nullif("rows", F.lit(0))
    counts = {"missing": zero(F.col("missing")), "missing_pct": share("missing"), "unique_values": zero(F.col("unique_values")), "unique_pct": share("unique_values")}
    counts |= {"zeros": zero(F.col("zeros"), "number"), "negatives": zero(F.col("negatives"), "number"), "empty_strings": zero(F.col("empty_strings"), "text_")}
    return joined.select("column_name", "data_type", *[counts.get(c, F.col(c)).alias(c) for c in STATS])


#: A column is dense if its values lie in a range of so many times their number.
DENSE = 64


def distinct_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column_name, unique_values) of columns of whole numbers, exactly, and without a shuffle of their values where they are dense, as numbered keys are.

    Dense columns become bitmaps, of 32,768 numbers each, that are joined before and after the shuffle: an eighth of a byte for a
    number of the range. The others are counted by value. One pass finds the ranges, one counts the dense columns, one the others.
    """
    spark = df.sparkSession
    picked = [*(names or [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)])]
    value = lambda c: F.col(f"`{c}`").cast("long")
    ends = df.agg(*[F.struct(F.count(value(c)).alias("n"), F.min(value(c)).alias("low"), F.max(value(c)).alias("high")).alias(f"c{k}") for k, c in enumerate(picked)]).first() if picked else []
    dense = [k for k, e in enumerate(ends) if e["n"] and e["high"] - e["low"] < DENSE * e["n"]]
    sparse = [k for k, e in enumerate(ends) if e["n"] and k not in dense]
    cells = lambda some: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("col"), value(picked[k]).alias("v")) for k in some])).alias("c")).select("c.*").where("v is not null")
    parts = [spark.createDataFrame([(k, 0) for k, e in enumerate(ends) if not e["n"]], "col int, unique_values long")]
    if dense:
        bits = cells(dense).groupBy("col", F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
        parts.append(bits.groupBy("col").agg(F.sum(F.bitmap_count("bits")).alias("unique_values")))
    if sparse:
        parts.append(cells(sparse).groupBy("col", "v").agg(F.lit(1).alias("one")).groupBy("col").agg(F.count("*").alias("unique_values")))
    name = F.element_at(F.array(*[F.lit(c) for c in picked]), F.col("col") + 1) if picked else F.lit("")
    return functools.reduce(DataFrame.unionByName, parts).select(name.alias("column_name"), "unique_values")


def completeness(df: DataFrame) -> DataFrame:
    """One row: the mean of the columns' missing percentages."""
    return columns(df).agg(F.avg("missing_pct").alias("mean_missing_pct"))


def missing_counts(df: DataFrame) -> dict[str, int]:
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first().asDict()


def missing_correlation(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(a, b, corr) for each pair of columns that are missing in some rows; from counts alone, null where a column never varies.

    Rows are first counted by which columns they lack, so pairs are formed of a few patterns, not of rows.
    """
    names = [*(names or df.columns)]
    gone = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in names]))
    patterns = settle(df.select(gone.alias("gone")).groupBy("gone").agg(F.count("*").cast("double").alias("n")))
    met = patterns.select("n", "gone", F.explode("gone").alias("a")).select("n", "a", F.explode("gone").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("s_ab"))
    alone = lambda x: met.where("a = b").select(F.col("a").alias(x), F.col("s_ab").alias(f"s_{x}"))
    pairs = df.sparkSession.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i:]], "a string, b string")
    joined = pairs.join(alone("a"), "a").join(alone("b"), "b").join(met, ["a", "b"], "left").crossJoin(F.broadcast(patterns.agg(F.sum("n").alias("n"))))
    n, sa, sb = F.col("n"), F.col("s_a"), F.col("s_b")
    spread = F.sqrt((n * sa - sa * sa) * (n * sb - sb * sb))
    return joined.select("a", "b", ((n * F.coalesce("s_ab", F.lit(0.0)) - sa * sb) / F.nullif(spread, F.lit(0.0))).alias("corr"))


def missing_blocks(df: DataFrame, least: float = 0.95) -> DataFrame:
    """(columns, rows_missing_all, pct): columns that are missing together.

    Columns by falling number of missing values join the first block whose first member they correlate
    with at ``least`` or more; blocks of one are dropped. The matrix has the size of the schema.
    """
    counts = missing_counts(df)
    order = sorted((c for c, n in counts.items() if n), key=lambda c: (-counts[c], df.columns.index(c)))
    spark = df.sparkSession
    schema = "columns array<string>, rows_missing_all long, pct double"
    if not order:
        return spark.createDataFrame([], schema)
    corr = {}
    for r in missing_correlation(df, order).collect():
        corr[r["a"], r["b"]] = corr[r["b"], r["a"]] = r["corr"]
    blocks: list[list[str]] = []
    for c in order:
        home = next((b for b in blocks if (corr.get((b[0], c)) or 0.0) >= least), None)
        blocks.append([c]) if home is None else home.append(c)
    blocks = [b for b in blocks if len(b) > 1]
    if not blocks:
        return spark.createDataFrame([], schema)
    every = lambda b: F.count_if(F.array_max(F.array(*[F.col(f"`{c}`").isNotNull().cast("int") for c in b])) == 0)
    rows = [F.struct(F.array(*[F.lit(c) for c in b]).alias("columns"), every(b).alias("rows_missing_all"), F.bround(100.0 * every(b) / F.nullif(F.count("*"), F.lit(0)), 1).alias("pct")) for b in blocks]
    return df.agg(F.array(*rows).alias("b")).select(F.inline("b"))


def cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(g, x, n) of numeric columns, numbered in the order of ``names``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("g"), F.col(f"`{c}`").cast("double").alias("x")) for k, c in enumerate(names)]))
    return df.select(each.alias("c")).select("c.g", "c.x", F.lit(1).cast("long").alias("n"))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a numeric column, between ranks in proportion; all None if it has no value."""
    return quantiles_by_group(cells(df, [column]), shares).get(0, [None] * len(shares))


def numeric_summary(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, sample deviation, least, exact quartiles and 95th percentile, greatest, missing. A fixed number of passes, however many columns."""
    picked = [*(names or [f.name for f in df.schema if numeric(f)])]
    shares = (0.25, 0.5, 0.75, 0.95)
    found = quantiles_by_group(cells(df, picked), shares)
    rows = []
    for k, c in enumerate(picked):
        x = F.col(f"`{c}`").cast("double")
        q = [F.lit(v).cast("double") for v in found.get(k, [None] * len(shares))]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), q[3].alias("q95"), F.max(x).alias("max"), F.count_if(x.isNull()).alias("missing")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows strictly beyond the quartiles by ``factor`` times their distance."""
    low, high = (F.lit(x).cast("double") for x in quantiles(df, column, (0.25, 0.75)))
    margin = factor * (high - low)
    return df.where((F.col(column) < low - margin) | (F.col(column) > high + margin))


def value_counts(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    value = F.coalesce(F.col(column).cast("string"), F.lit("(missing)"))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(limit)


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): fixed-width bins 1..``bins``; 0 and ``bins`` + 1 hold what lies outside."""
    return df.where(value.isNotNull()).groupBy(F.width_bucket(value.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def short_addresses(df: DataFrame, address: str, least: int = 10, limit: int = 10, key: str = "unique_id") -> dict[str, DataFrame]:
    """Samples in order of the key: present addresses that are short, and those long enough without a digit."""
    c = F.col(address)
    present, short, digit = c.isNotNull() & (F.trim(c) != ""), F.length(c) < least, c.rlike(r"\d")
    return {"short": df.where(present & short).orderBy(key).limit(limit), "no_digit": df.where(present & ~short & ~digit).orderBy(key).limit(limit)}


def address_quality(df: DataFrame, address: str, city: str | None = None) -> DataFrame:
    """One row: percentages with a digit, with a city (a comma, or ``city`` given), placeholders, over addresses present; and missing, over all."""
    c = F.col(address)
    n, present = F.count("*"), F.count(c)
    placed = c.contains(",") if city is None else c.contains(",") | F.col(city).isNotNull()
    pct = lambda x, of: 100.0 * x / F.nullif(of, F.lit(0))
    return df.agg(pct(F.count_if(c.rlike(r"\d")), present).alias("with_digit_pct"), pct(F.count_if(c.isNotNull() & placed), present).alias("with_city_pct"), F.count_if(c.rlike(r"^0( |\z)")).alias("placeholders"), pct(F.count_if(c.isNull()), n).alias("missing_pct"))

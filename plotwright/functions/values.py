"""Prices, dates and places, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = r"^\s*\$?\s*\d+(\.\d+)?\s*$"
# The box that coordinates must lie in, edges included.
LATITUDES = (35.0, 36.7)
LONGITUDES = (-87.6, -85.7)
# Spellings of dates, tried in turn.
DATE_FORMATS = ["yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy", "yyyyMMdd"]


def bad_price(text: Column) -> Column:
    """Whether a price cannot be read: negatives, blanks and currency names are refused, null is not."""
    return ~F.replace(text, F.lit(","), F.lit("")).rlike(PRICE)


def parse_price(text: Column) -> Column:
    return F.regexp_substr(F.replace(text, F.lit(","), F.lit("")), F.lit(r"\d+(?:\.\d+)?")).cast("decimal(38,10)")


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in formats], F.trim(text).try_cast("timestamp").cast("date"))


def in_bounds(latitude: Column, longitude: Column) -> Column:
    return latitude.between(*LATITUDES) & longitude.between(*LONGITUDES)


def needs_geocoding(latitude: Column, longitude: Column) -> Column:
    return latitude.isNull() | longitude.isNull()


def needs_attention(status: Column, latitude: Column, longitude: Column) -> Column:
    return F.coalesce(status == "FAILED", F.lit(False)) | needs_geocoding(latitude, longitude)


def point(latitude: Column, longitude: Column) -> Column:
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.struct(longitude.alias("lon"), latitude.alias("lat")))


def ewkt(geom: Column) -> Column:
    return F.when(geom.isNotNull(), F.format_string("SRID=4326;POINT(%s %s)", geom["lon"].cast("string"), geom["lat"].cast("string")))


def nice_round(value: Column) -> Column:
    """To two significant digits, halves to even; 0 for what is not positive."""
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
    return F.when(value <= 0, 0.0).otherwise(F.bround(value / magnitude) * magnitude)


def bucket(price: Column, breaks: Column) -> Column:
    """How many of the sorted ``breaks`` are at or below the price."""
    return F.when(price.isNotNull(), F.size(F.filter(breaks, lambda b: b <= price)))

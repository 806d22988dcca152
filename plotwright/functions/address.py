"""Parsing and standardising of addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plotwright.functions.text import first_group

# Abbreviations of street types and directions, in the order in which they apply.
STREET_TYPES = {"RD": "ROAD", "ST": "STREET", "AVE": "AVENUE", "BLVD": "BOULEVARD", "DR": "DRIVE", "LN": "LANE", "CT": "COURT", "CIR": "CIRCLE", "PLZ": "PLAZA", "SQ": "SQUARE", "TER": "TERRACE", "PKWY": "PARKWAY", "HWY": "HIGHWAY"}
DIRECTIONS = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST"}
# Fixed value: what counts as a house number.
HOUSE_NUMBER = r"^\s*(\d+(?:-\d+)?)\s"


def standardize_abbreviations(address: Column) -> Column:
    """Upper case, street types (before a comma, a blank or the end) and directions (between blanks) written out."""
    out = F.upper(address)
    for short, long in STREET_TYPES.items():
        # Each context is a pass of its own, as matches share their blanks.
        out = F.replace(out, F.lit(f" {short},"), F.lit(f" {long},"))
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {long} "))
        out = F.regexp_replace(out, rf" {short}\z", f" {long}")
    for short, long in DIRECTIONS.items():
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {long} "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def house_number(address: Column) -> Column:
    return first_group(address, HOUSE_NUMBER)


def street_name(address: Column) -> Column:
    """Without the house number, up to the first comma."""
    return F.trim(F.substring_index(F.regexp_replace(address, r"^\s*\d+(?:-\d+)?\s+", ""), ",", 1))


def city(address: Column) -> Column:
    """Between the first comma and the second; null without a comma."""
    return F.when(F.instr(address, ",") > 0, F.trim(F.split_part(address, F.lit(","), F.lit(2))))


def components(address: Column) -> Column:
    return F.struct(house_number(address).alias("house_number"), street_name(address).alias("street_name"), city(address).alias("city"), standardize_abbreviations(address).alias("standardized_address"))


def street_key(address: Column) -> Column:
    """What the address dimension holds: the part before the first comma, in upper case; null if blank."""
    return F.nullif(F.upper(F.trim(F.split_part(address, F.lit(","), F.lit(1)))), F.lit(""))


def city_key(address: Column) -> Column:
    return F.nullif(F.upper(F.trim(F.split_part(address, F.lit(","), F.lit(2)))), F.lit(""))


def register_sql(spark: SparkSession) -> None:
    """The parsing functions for SQL text: scalar ones, and parse_address_components for LATERAL joins."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION extract_house_number(address STRING) RETURNS STRING RETURN nullif(regexp_extract(address, r'^\s*(\d+(?:-\d+)?)\s', 1), '')")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION extract_street_name(address STRING) RETURNS STRING RETURN trim(substring_index(regexp_replace(address, r'^\s*\d+(?:-\d+)?\s+', ''), ',', 1))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extract_city(address STRING) RETURNS STRING RETURN CASE WHEN instr(address, ',') > 0 THEN trim(split_part(address, ',', 2)) END")
    step = "upper(address)"
    for short, long in STREET_TYPES.items():
        step = f"regexp_replace(replace(replace({step}, ' {short},', ' {long},'), ' {short} ', ' {long} '), r' {short}\\z', ' {long}')"
    for short, long in DIRECTIONS.items():
        step = f"replace({step}, ' {short} ', ' {long} ')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION standardize_address_abbreviations(address STRING) RETURNS STRING RETURN trim(regexp_replace({step}, r'\\s+', ' '))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clean_all(text STRING, pattern STRING) RETURNS STRING RETURN trim(regexp_replace(text, pattern, ''))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION parse_address_components(address STRING) RETURNS TABLE(house_number STRING, street_name STRING, city STRING, standardized_address STRING) RETURN SELECT extract_house_number(address), extract_street_name(address), extract_city(address), standardize_address_abbreviations(address)")

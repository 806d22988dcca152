"""Scalar functions on text, as column expressions: no UDF, so they stay in generated code and push down."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_all(text: Column, pattern: str) -> Column:
    """All matches removed, then blanks trimmed."""
    return F.trim(F.regexp_replace(text, pattern, ""))


def count_substring(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in the set ``characters`` (a set, whatever the name says)."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]", ""))


def spaces(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^ ]+", ""))


def collapse_spaces(text: Column) -> Column:
    # Most texts have none, which needs no pattern to be seen.
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def blank(text: Column) -> Column:
    """Null, or nothing but blanks."""
    return text.isNull() | (F.trim(text) == "")


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null, not '', without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def yes_no(text: Column) -> Column:
    return F.when(text.isin("Yes", "Y"), True).when(text.isin("No", "N"), False)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; null for two empty texts."""
    return 1 - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))


def mentions_tennessee(text: Column) -> Column:
    return text.rlike(r"(?i)\bTN\b|\bTennessee\b")


def normalize_state(text: Column) -> Column:
    """Every input, null too, stands for the one state of the data."""
    return F.lit("TN")


def snake_case(name: str) -> str:
    """UniqueID becomes unique_id: an underscore between a lower-case letter and a capital, all in lower case."""
    return re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower().strip()


def snake_case_loose(name: str) -> str:
    """The other renaming: lower case first (so no word edges remain), signs to words or underscores."""
    special = {"suite/ condo   #": "suite_or_condo", "Unnamed: 0": "unique_id"}
    if name in special:
        return special[name]
    out = name.lower().replace("/", "_or_").replace("#", "")
    return re.sub(r"_+", "_", re.sub(r"\s+", "_", out)).strip("_")


def columns_except(columns: Sequence[str], out: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in out]


def quoted_columns(columns: Column) -> Column:
    """An array of names as a quoted list."""
    return F.array_join(F.transform(columns, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ", ")


def original_address(address: Column, city: Column) -> Column:
    return F.when(address.isNotNull(), F.concat_ws(", ", address, F.nullif(city, F.lit(""))))


def full_address(address: Column, city: Column) -> Column:
    """What a geocoder is asked for: the state is added where it is not named."""
    base = original_address(address, city)
    return F.when(mentions_tennessee(base), base).otherwise(F.concat(base, F.lit(", TN")))


def percent_label(count: Column, total: Column) -> Column:
    share = F.when(total == 0, 0.0).otherwise(count / F.nullif(total, F.lit(0)) * 100)
    return F.format_string("%d (%.1f%%)", count.cast("long"), share.cast("double"))


def confidence_label(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.2f", value.cast("double")))


def bathrooms(full: Column, half: Column) -> Column:
    return F.coalesce(full, F.lit(0.0)) + F.coalesce(half, F.lit(0.0)) * 0.5


def or_na(value: Column, shown: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(shown)


def csv_value(column: Column, kind: str) -> Column:
    """A cell as text: null empty, booleans t and f, doubles as Python prints those of everyday size."""
    if kind == "boolean":
        out = F.when(column, "t").when(~column, "f")
    elif kind in ("double", "float"):
        plain = F.regexp_replace(column.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
        # Within the second bounds Java prints no exponent, so the text needs no further work.
        out = F.when(column == 0, "0.0").when((F.abs(column) >= 1e-3) & (F.abs(column) < 1e7), column.cast("string")).when((F.abs(column) >= 1e-4) & (F.abs(column) < 1e16), plain).otherwise(F.lower(column.cast("string")))
    elif kind.startswith("decimal"):
        out = F.regexp_replace(F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    else:
        out = column.cast("string")
    return F.coalesce(out, F.lit(""))

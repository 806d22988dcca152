"""The cleaning sequence: raw text rows to typed, repaired, deduplicated sales. The order of the steps is part of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.functions.text import collapse_spaces, snake_case, yes_no
from plotwright.functions.values import bad_price, parse_date, parse_price
from plotwright.operators.dedup import keep_first
from plotwright.operators.fuzzy import correct_spacing, reconcile, split_initials, split_letters, street_from_owner
from plotwright.operators.impute import fill_all
from plotwright.operators.validate import require, require_key
from plotwright.schemas import NUMERIC_COLUMNS, SALE_KEY
from plotwright.storage import settle

PARTIES = [("property_address", "property_address_imputed"), ("owner_address", "owner_address_imputed")]


def rename(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def collapse(df: DataFrame) -> DataFrame:
    """Runs of blanks in all text columns, in one projection."""
    return df.select(*[collapse_spaces(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def checks() -> dict:
    """Rows that stop the run, by name."""
    date, vacant = F.col("sale_date"), F.col("sold_as_vacant")
    return {
        "sale_price": F.col("sale_price").isNotNull() & bad_price(F.col("sale_price")),
        "sold_as_vacant": vacant.isNotNull() & ~vacant.isin("Yes", "Y", "No", "N"),
        "sale_date": date.isNotNull() & parse_date(date).isNull(),
        "unique_id": F.col("unique_id").try_cast("long").isNull(),
    } | {c: F.col(c).isNotNull() & (F.trim(c) != "") & F.col(c).try_cast("double").isNull() for c in NUMERIC_COLUMNS}


def typed(df: DataFrame) -> DataFrame:
    """Types, constant currency and lowered flags. Reads what passed ``checks``."""
    return df.withColumns(
        {
            "unique_id": F.col("unique_id").cast("long"),
            "sale_date": parse_date(F.col("sale_date")),
            "sale_price": parse_price(F.col("sale_price")),
            "sold_as_vacant": yes_no(F.col("sold_as_vacant")),
            **{c: F.nullif(F.trim(c), F.lit("")).try_cast("double") for c in NUMERIC_COLUMNS},
            "currency_code": F.lit("USD"),
            **{flag: F.lit(False) for _, flag in PARTIES},
        }
    )


def repaired(df: DataFrame) -> DataFrame:
    """Fills, spelling, and the agreement of both addresses. The filled rows are kept, as the spelling reads them several times."""
    filled = settle(fill_all(df, [(["parcel_id"], *PARTIES[0]), (["parcel_id", "owner_name"], *PARTIES[1])]))
    out = correct_spacing(filled)
    address = split_letters(F.col("property_address"))
    address = street_from_owner(address, F.col("owner_address"))
    return reconcile(out.withColumn("property_address", split_initials(address)))


def clean(raw: DataFrame) -> DataFrame:
    """The whole sequence; raises ValidationError before any later step if rows are bad. The raw rows are evaluated once."""
    named = settle(collapse(rename(raw)))
    require_key(named, [named.columns[0]])
    require(named, checks())
    return keep_first(repaired(typed(named)), SALE_KEY, "unique_id")

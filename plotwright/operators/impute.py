"""Filling addresses from sibling rows, with a flag for every value that is not the source's own.

Donors are found by an aggregate per key and a join back, not by a window: a key with a third
of all rows is summed before the shuffle, and the join's large side can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import blank


def fill(df: DataFrame, keys: Sequence[str], target: str, flag: str, order: str = "unique_id") -> DataFrame:
    """Nulls of ``target`` take the value of the row of least ``order`` that has one, of those equal in ``keys``.

    Null keys equal nothing. ``flag`` turns true only where a value was filled.
    """
    return fill_all(df, [(keys, target, flag)], order)


def fill_all(df: DataFrame, fills: Sequence[tuple[Sequence[str], str, str]], order: str = "unique_id") -> DataFrame:
    """Several fills (keys, target, flag) of different columns, none of which is a key of another: all donors come from ``df`` itself."""
    out = df
    for k, (keys, target, flag) in enumerate(fills):
        present = F.col(target).isNotNull()
        for c in keys:
            present = present & F.col(c).isNotNull()
        donors = df.where(present).groupBy(*keys).agg(F.min_by(target, order).alias(f"donor_{k}_"))
        filled = F.col(target).isNull() & F.col(f"donor_{k}_").isNotNull()
        out = out.join(donors, [*keys], "left").withColumns({target: F.coalesce(target, f"donor_{k}_"), flag: F.coalesce(F.col(flag), F.lit(False)) | filled})
    return out.select(*df.columns)


def fill_from(df: DataFrame, source: DataFrame, on: Sequence[str], target: str, flag: str = "address_was_imputed", condition: Column | None = None, order: str = "unique_id") -> tuple[DataFrame, DataFrame]:
    """The general form: blanks of ``target`` take it from ``source``, a frame of its own. Returns the rows and a one-row frame with the true count."""
    donors = source.where(F.col(target).isNotNull()).groupBy(*on).agg(F.min_by(target, order).alias("donor_"))
    wanted = F.col(target).isNull() & (condition if condition is not None else F.lit(True))
    base = df if flag in df.columns else df.withColumn(flag, F.lit(False))
    joined = base.join(donors, [*on], "left").withColumn("filled_", F.coalesce(wanted & F.col("donor_").isNotNull(), F.lit(False)))
    out = joined.withColumns({target: F.when(F.col("filled_"), F.col("donor_")).otherwise(F.col(target)), flag: F.col(flag) | F.col("filled_")})
    return out.select(*base.columns), joined.agg(F.count_if("filled_").alias("filled"))


def mark_provenance(df: DataFrame, snapshot: DataFrame, pairs: Sequence[tuple[str, str]], key: str = "unique_id") -> DataFrame:
    """Flags (column, flag) raised where ``df`` has a value and the source snapshot had none."""
    was = snapshot.select(F.col(key).alias("s_key"), *[F.col(c).alias(f"s_{k}") for k, (c, _) in enumerate(pairs)])
    joined = df.join(was, df[key] == was["s_key"], "left")
    raised = {flag: F.coalesce(F.col(flag), F.lit(False)) | (F.col("s_key").isNotNull() & blank(F.col(f"s_{k}")) & F.col(c).isNotNull()) for k, (c, flag) in enumerate(pairs)}
    return joined.withColumns(raised).select(*df.columns)


def summary(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """How many rows are flagged, and how many are still without a value, for each pair."""
    return df.agg(*[x for c, flag in pairs for x in (F.count_if(flag).alias(flag), F.count_if(blank(F.col(c))).alias(f"{c}_missing"))], F.count("*").alias("rows"))


def shares(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Totals and percentages of imputed values."""
    return df.agg(*[x for f in flags for x in (F.count_if(f).alias(f"{f}_n"), F.round(100 * F.count_if(f) / F.nullif(F.count("*"), F.lit(0)), 6).alias(f"{f}_pct"))])

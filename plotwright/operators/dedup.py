"""Duplicates by a business key. Null keys equal each other here, as in a partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row of each key: that of least ``order``, null before all. By an aggregate, so a key with very many rows (as all-null ones may be) is summed before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(F.col(order).isNotNull(), F.col(order)))
    return df.groupBy(*keys).agg(first.alias("first_")).select(*[F.col(f"`{c}`") if c in keys else F.col(f"first_.`{c}`") for c in df.columns])


def later_ids(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The ids (``order``, one row each) of all rows but the first of each key."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(order), F.struct(F.col(order).isNotNull(), F.col(order))).alias("first_")).select(F.col(f"first_.{order}").alias("first_"))
    return df.select(order).join(first, F.col(order).eqNullSafe(F.col("first_")), "left_anti")


def delete(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` without the rows whose ``column`` is among ``ids`` (its one column)."""
    gone = ids.toDF("gone_id")
    return df.join(gone, F.col(column) == F.col("gone_id"), "left_anti")


def delete_with_dependents(sales: DataFrame, mappings: DataFrame, issues: DataFrame, keys: Sequence[str], order: str = "unique_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without later duplicates and what hangs on them."""
    ids = later_ids(sales, keys, order)
    return delete(sales, ids, order), delete(mappings, ids, "housing_id"), delete(issues, ids, order)


def groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def excess(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: groups met more than once, and their rows beyond the first."""
    return groups(df, keys).agg(F.count("*").alias("dup_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"))

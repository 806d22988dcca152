"""Checks that stop a run before anything is written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """What was found wrong, by name of the check."""

    def __init__(self, found: Mapping[str, int]):
        self.found = dict(found)
        super().__init__("; ".join(f"{name}: {n} rows" for name, n in self.found.items()))


def bad_counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows each check finds bad, all in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])


def require(df: DataFrame, checks: Mapping[str, Column]) -> None:
    found = bad_counts(df, checks).first().asDict()
    if bad := {k: n for k, n in found.items() if n}:
        raise ValidationError(bad)


def key_faults(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or met more than once, with their number of rows."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(null | (F.col("rows") > 1))


def require_key(df: DataFrame, keys: Sequence[str]) -> None:
    if n := key_faults(df, keys).count():
        raise ValidationError({f"key ({', '.join(keys)})": n})


def require_unique(df: DataFrame, key: str) -> None:
    """No value of ``key`` twice; nulls are not looked at."""
    if n := df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").count():
        raise ValidationError({f"repeated {key}": n})


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of ``child`` whose reference (child column to parent column) has no target; nulls refer to nothing."""
    targets = parent.select(*[F.col(p).alias(f"p_{k}") for k, p in enumerate(on.values())]).distinct()
    condition = F.lit(True)
    for k, c in enumerate(on):
        condition = condition & (F.col(c) == F.col(f"p_{k}"))
    present = F.lit(True)
    for c in on:
        present = present & F.col(c).isNotNull()
    return child.where(present).join(targets, condition, "left_anti")


def require_reference(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> None:
    if n := orphans(child, parent, on).count():
        raise ValidationError({f"reference ({', '.join(on)})": n})


def export_invariants(full: DataFrame, public: DataFrame, owner_columns: Sequence[str]) -> dict[str, int]:
    """Faults by invariant, of the two exports read back as text; empty if both are as they must be."""
    from plotwright.functions.values import in_bounds

    texts = [c for c, t in full.dtypes if t == "string"]
    doubled = F.lit(False)
    for c in texts:
        doubled = doubled | F.coalesce(F.col(c).contains("  "), F.lit(False))
    number = lambda c: F.col(c).try_cast("double")
    outside = lambda a, b: F.coalesce(~in_bounds(number(a), number(b)), F.lit(False))
    found = bad_counts(
        full,
        {
            "property_address": F.col("property_address").isNull() | (F.col("property_address") == ""),
            "sold_as_vacant": ~F.coalesce(F.col("sold_as_vacant"), F.lit("")).isin("t", "f", ""),
            "double spaces": doubled,
            "sale_price": (F.coalesce(F.col("sale_price"), F.lit("")) != "") & number("sale_price").isNull(),
            "coordinates": outside("property_latitude", "property_longitude") | outside("owner_latitude", "owner_longitude"),
        },
    ).first().asDict()
    hidden = F.lit(False)
    for c in owner_columns:
        hidden = hidden | (F.coalesce(F.col(c), F.lit("")) != "")
    found["redaction"] = public.where(hidden).count()
    found["empty"] = int(full.limit(1).count() == 0) + int(public.limit(1).count() == 0)
    found["rows differ"] = abs(full.count() - public.count())
    return {k: n for k, n in found.items() if n}

"""Upkeep of the list of quality issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = r"^0( |\z)"
ISSUE = "placeholder_address"


def placeholder_issues(sales: DataFrame, issues: DataFrame, address: str = "property_address", issue: str = ISSUE) -> DataFrame:
    """New issues: placeholder addresses that are not listed yet."""
    found = sales.where(F.col(address).rlike(PLACEHOLDER)).select("unique_id", F.col(address).alias("address1"), F.lit(None).cast("string").alias("address2"), F.lit(issue).alias("issue_type"))
    return found.join(issues.select("unique_id", "issue_type"), ["unique_id", "issue_type"], "left_anti").select("unique_id", "address1", "address2", "issue_type")


def by_type(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "issue_type")


def overview(sales: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: sales, duplicate groups left, issues listed."""
    duplicates = sales.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicate_groups"))
    return sales.agg(F.count("*").alias("sales")).crossJoin(duplicates).crossJoin(issues.agg(F.count("*").alias("issues")))

"""The durable address dimension: insert-only, keyed by address text, with mappings rebuilt from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwright.functions.address import city_key, standardize_abbreviations, street_key
from plotwright.schemas import ADDRESSES
from plotwright.storage import settle

TYPES = {"property": "property_address", "owner": "owner_address"}


def candidates(sales: DataFrame, columns: Sequence[str] = tuple(TYPES.values())) -> DataFrame:
    """(address, city): each address once, with its least city that is not null. One scan for all columns."""
    parts = F.explode(F.array(*[F.struct(street_key(F.col(c)).alias("address"), city_key(F.col(c)).alias("city")) for c in columns]))
    return sales.select(parts.alias("c")).select("c.address", "c.city").where("address is not null").groupBy("address").agg(F.min("city").alias("city"))


def numbered(df: DataFrame, order: Sequence[str], name: str, after: int) -> DataFrame:
    """Dense numbers from ``after`` + 1 in ``order``, without gathering all rows in one task.

    Rows are dealt by ranges of the order (kept, as a second deal could differ); each range counts on from those before it.
    """
    parts = settle(df.repartitionByRange(*order).withColumn("p_", F.spark_partition_id()))
    sizes = parts.groupBy("p_").count()
    offsets = sizes.select("p_", (F.coalesce(F.sum("count").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + after).alias("o_"))
    rank = F.row_number().over(Window.partitionBy("p_").orderBy(*order))
    return parts.join(F.broadcast(offsets), "p_").withColumn(name, (rank + F.col("o_")).cast("long")).drop("p_", "o_")


def upsert(cache: DataFrame, sales: DataFrame) -> DataFrame:
    """Cached rows untouched, new addresses appended with numbers after the greatest."""
    new = candidates(sales).join(cache.select("address"), "address", "left_anti")
    last = cache.agg(F.max("address_id")).first()[0] or 0
    rows = numbered(new, ["address"], "address_id", last)
    rows = rows.withColumns({"address_hash": F.md5(F.encode("address", "UTF-8")), "address_standardized": standardize_abbreviations(F.col("address"))})
    have = set(rows.columns)
    return cache.unionByName(rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ADDRESSES]), allowMissingColumns=True)


def mappings(sales: DataFrame, cache: DataFrame) -> DataFrame:
    """(mapping_id, housing_id, address_id, address_type), rebuilt whole."""
    sides = F.explode(F.array(*[F.struct(F.lit(t).alias("address_type"), street_key(F.col(c)).alias("address")) for t, c in TYPES.items()]))
    asked = sales.select(F.col("unique_id").alias("housing_id"), sides.alias("s")).select("housing_id", "s.*").where("address is not null")
    joined = asked.join(cache.select("address", "address_id"), "address").select("housing_id", "address_id", "address_type")
    return numbered(joined, ["housing_id", "address_type"], "mapping_id", 0).select("mapping_id", "housing_id", "address_id", "address_type")


def mapped_ids(map_rows: DataFrame, cache: DataFrame, address_type: str | None = None, pending: bool = False) -> DataFrame:
    """Distinct address ids, of one type and still without coordinates if so asked, in order."""
    some = map_rows if address_type is None else map_rows.where(F.col("address_type") == address_type)
    rows = cache.where(F.col("latitude").isNull() | F.col("longitude").isNull()) if pending else cache
    return rows.join(some.select("address_id"), "address_id", "left_semi").select("address_id").distinct()

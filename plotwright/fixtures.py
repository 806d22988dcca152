"""Messy inputs, derived from the clean driver tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

KIND = "CASE k % 13 WHEN 0 THEN 'rd' WHEN 1 THEN 'ST' WHEN 2 THEN 'AVE' WHEN 3 THEN 'BLVD' WHEN 4 THEN 'DR' WHEN 5 THEN 'LN' WHEN 6 THEN 'CT' WHEN 7 THEN 'CIR' WHEN 8 THEN 'PLZ' WHEN 9 THEN 'SQ' WHEN 10 THEN 'TER' WHEN 11 THEN 'PKWY' ELSE 'HWY' END"

#: Sales in the cleaned shape. k: the customer, so that a parcel's rows share an address.
SALES = f"""
SELECT o_orderkey AS unique_id, parcel_id, land_use,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN '0 ' || street || ', ' || place ELSE cast(k % 90 + 1 AS string) || ' ' || street || ', ' || place END AS property_address,
  cast(o_orderdate AS date) AS sale_date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE cast(floor(o_totalprice) AS double) END AS sale_price,
  'L' || cast(o_orderkey % 3 AS string) AS legal_reference, o_orderkey % 4 = 0 AS sold_as_vacant,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE c_name END AS owner_name,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN cast(k % 90 + 1 AS string) || ' ' || street || ', ' || place || ', TN' ELSE cast(k % 70 + 1 AS string) || ' ' || c_mktsegment || ' N ' || kind || ', ' || place || ', TN' END AS owner_address,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE cast(o_orderkey % 400 AS double) / 100 END AS acreage,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE cast(o_orderkey % 1000 AS double) * 100 END AS land_value,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE cast(1900 + o_orderkey % 120 AS double) END AS year_built,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE cast(o_orderkey % 6 AS double) END AS bedrooms,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE cast(o_orderkey % 4 AS double) END AS full_bath,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE cast(o_orderkey % 2 AS double) END AS half_bath,
  false AS property_address_imputed, false AS owner_address_imputed
FROM (SELECT *, c_mktsegment || ' ' || kind AS street, n_name AS place, 'P' || cast(o_custkey % 500 AS string) AS parcel_id, o_orderpriority AS land_use
  FROM (SELECT *, {KIND} AS kind FROM (SELECT *, o_custkey AS k FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey) a) b) c
"""
ADDRESSES = f"""
SELECT c_custkey AS address_id, cast(c_custkey AS string) || ' ' || c_mktsegment || ' ' || kind AS address, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE n_name END AS city,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 34.9 + cast(c_custkey % 190 AS double) / 100 END AS latitude,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE -87.7 + cast(c_custkey % 210 AS double) / 100 END AS longitude,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS corrected_address,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE cast(c_custkey % 100 AS double) / 100 END AS geocode_confidence,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'HERE' ELSE 'OSM' END AS geocode_source,
  CASE WHEN c_custkey % 5 = 0 THEN (CASE WHEN c_custkey % 2 = 0 THEN 'FAILED' END) WHEN c_custkey % 31 = 0 THEN 'MANUALLY_CORRECTED' ELSE 'GEOCODED' END AS geocode_status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '2024-01-01' - cast(c_custkey % 700 AS int) END AS geocoded_at,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(c_mktsegment) END AS address_standardized
FROM (SELECT *, {KIND} AS kind FROM (SELECT *, c_custkey AS k FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey) a) b
"""
MAPPINGS = """
SELECT o_orderkey * 2 AS mapping_id, o_orderkey AS housing_id, o_custkey AS address_id, 'property' AS address_type FROM {orders} WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey * 2 + 1 AS mapping_id, o_orderkey AS housing_id, (o_custkey * 7 + 3) % 1200 AS address_id, 'owner' AS address_type FROM {orders} WHERE o_orderkey % 4 <> 0
"""
#: Raw text rows, good enough to pass the checks; some addresses need each of the repairs.
RAW = """
SELECT cast(unique_id AS string) AS `UniqueID`, parcel_id AS `ParcelID`, land_use AS `LandUse`,
  replace(CASE WHEN unique_id % 53 = 1 THEN '1 FALL CREEK DR, X' WHEN unique_id % 61 = 2 THEN '12 AB STREET, X' WHEN unique_id % 67 = 3 THEN '7 BCREEK RD, X' WHEN unique_id % 2 = 0 THEN property_address ELSE replace(replace(property_address, 'MACHINERY', 'MACHI NERY'), 'HOUSEHOLD', 'HOUSE HOLD') END, ' ', '  ') AS `PropertyAddress`, cast(sale_date AS string) AS `SaleDate`,
  '$' || cast(cast(coalesce(sale_price, 1000) AS bigint) AS string) AS `SalePrice`, legal_reference AS `LegalReference`, CASE unique_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Y' WHEN 2 THEN 'No' ELSE 'N' END AS `SoldAsVacant`,
  owner_name AS `OwnerName`, owner_address AS `OwnerAddress`, cast(acreage AS string) AS `Acreage`, 'URBAN' AS `TaxDistrict`, cast(land_value AS string) AS `LandValue`, '1' AS `BuildingValue`, '2' AS `TotalValue`,
  cast(year_built AS string) AS `YearBuilt`, cast(bedrooms AS string) AS `Bedrooms`, cast(full_bath AS string) AS `FullBath`, cast(half_bath AS string) AS `HalfBath` FROM {sales}
"""
VIEWS = {"sales": SALES, "addresses": ADDRESSES, "mappings": MAPPINGS}


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the driver tables and the views here, each named in braces."""
    names = {*re.findall(r"\{(\w+)\}", sql)}
    frames = {n: read(spark, sf_dir, VIEWS[n]) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(sql, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, VIEWS[name])


def counts(sql: str) -> str:
    """count_if as a filtered count, whose type is the same on both sides."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def duckdb(sql: str) -> str:
    """``sql`` for DuckDB, with the views that it names in braces as common table expressions."""
    plain = lambda s: counts(re.sub(r"\{(\w+)\}", r"\1", s).strip())
    used = [n for n in VIEWS if "{" + n + "}" in sql]
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in used)
    body = plain(sql)
    if not ctes:
        return body
    return f"WITH RECURSIVE {ctes}, {body[14:].lstrip()}" if body.startswith("WITH RECURSIVE") else f"WITH {ctes}, {body[4:].lstrip()}" if body.startswith("WITH") else f"WITH {ctes} {body}"

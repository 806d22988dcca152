"""The registered queries, each through the engine's operators, and their equivalents for DuckDB."""

from __future__ import annotations

import contextlib
import datetime
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright import fixtures
from plotwright.functions import address as A
from plotwright.functions import text as X
from plotwright.functions import values as V
from plotwright.operators import cache, dedup, fuzzy, geocode, impute, marts, procedures, profile, quality, quota, validate
from plotwright.operators.clean import PARTIES, clean, collapse
from plotwright.plans import prepare
from plotwright.schemas import ADDRESSES as ADDRESS_SCHEMA
from plotwright.schemas import CLEAN_COLUMNS, CORRECTION_LOG, EXPORT_COLUMNS, EXPORTED, ISSUES, OWNER_COLUMNS, POINT_COLUMNS, RAW_COLUMNS, USAGE, fields
from plotwright.sources import exports, lookups, spatial, tables
from plotwright.sources.providers import ByRule
from plotwright.storage import Ledger, scratch
from plotwright.streaming import quota as stream_quota

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = fixtures.duckdb(sql)
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def v(spark: SparkSession, d: str, name: str) -> DataFrame:
    return fixtures.view(spark, d, name)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Impute, deduplicate, summarise."""
    sales = impute.fill(v(spark, d, "sales"), ["parcel_id"], *PARTIES[0])
    sales = dedup.keep_first(sales, ["parcel_id", "property_address", "sale_price", "sale_date", "legal_reference"], "unique_id")
    return impute.summary(sales, PARTIES)


L = lambda c: F.col(c).cast("long").alias(c)
S = lambda c: F.col(c).cast("string").alias(c)


# --- duplicates ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_business_key(spark, d):
    return dedup.keep_first(t(spark, d, "orders"), ["o_custkey", "o_orderdate"], "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT count(*) AS dup_groups, cast(coalesce(sum(n - 1), 0) AS bigint) AS excess_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_groups(spark, d):
    return dedup.excess(t(spark, d, "documents"), ["text"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return dedup.groups(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT unique_id FROM (SELECT unique_id, row_number() OVER (PARTITION BY parcel_id, property_address, sale_date ORDER BY unique_id) AS rn FROM {sales}) WHERE rn > 1")
def duplicate_ids_null_keys(spark, d):
    return dedup.later_ids(v(spark, d, "sales"), ["parcel_id", "property_address", "sale_date"], "unique_id")


@query("WITH gone AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1) SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone) GROUP BY l_orderkey")
def delete_using(spark, d):
    ids = dedup.later_ids(t(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")
    return dedup.delete(t(spark, d, "lineitem"), ids, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("WITH gone AS (SELECT unique_id FROM (SELECT unique_id, row_number() OVER (PARTITION BY parcel_id, land_use ORDER BY unique_id) AS rn FROM {sales}) WHERE rn > 1) SELECT 'sales' AS name, unique_id AS id FROM {sales} WHERE unique_id NOT IN (SELECT unique_id FROM gone) UNION ALL SELECT 'mappings', mapping_id FROM {mappings} WHERE housing_id NOT IN (SELECT unique_id FROM gone) UNION ALL SELECT 'issues', unique_id FROM {sales} WHERE owner_address IS NULL AND unique_id NOT IN (SELECT unique_id FROM gone)")
def delete_dependents(spark, d):
    sales = v(spark, d, "sales")
    out = dedup.delete_with_dependents(sales, v(spark, d, "mappings"), sales.where("owner_address is null").select("unique_id"), ["parcel_id", "land_use"])
    one = lambda name, df, key: df.select(F.lit(name).alias("name"), F.col(key).alias("id"))
    return one("sales", out[0], "unique_id").unionByName(one("mappings", out[1], "mapping_id")).unionByName(one("issues", out[2], "unique_id"))


# --- imputation ---------------------------------------------------------------------------------


@query("WITH donor AS (SELECT parcel_id, arg_min(property_address, unique_id) AS a FROM {sales} WHERE property_address IS NOT NULL GROUP BY 1) SELECT unique_id, coalesce(property_address, a) AS property_address, property_address IS NULL AND a IS NOT NULL AS property_address_imputed FROM {sales} LEFT JOIN donor USING (parcel_id)")
def impute_sibling(spark, d):
    return impute.fill(v(spark, d, "sales"), ["parcel_id"], *PARTIES[0]).select("unique_id", "property_address", "property_address_imputed")


@query("WITH donor AS (SELECT parcel_id, owner_name, arg_min(owner_address, unique_id) AS a FROM {sales} WHERE owner_address IS NOT NULL AND owner_name IS NOT NULL GROUP BY 1, 2) SELECT s.unique_id, coalesce(owner_address, a) AS owner_address, owner_address IS NULL AND a IS NOT NULL AS owner_address_imputed FROM {sales} s LEFT JOIN donor ON s.parcel_id = donor.parcel_id AND s.owner_name = donor.owner_name")
def impute_two_key(spark, d):
    return impute.fill(v(spark, d, "sales"), ["parcel_id", "owner_name"], *PARTIES[1]).select("unique_id", "owner_address", "owner_address_imputed")


@query("WITH donor AS (SELECT parcel_id, arg_min(property_address, unique_id) AS a FROM {sales} WHERE property_address IS NOT NULL GROUP BY 1) SELECT unique_id, CASE WHEN property_address IS NULL AND NOT sold_as_vacant THEN a ELSE property_address END AS property_address, property_address IS NULL AND NOT sold_as_vacant AND a IS NOT NULL AS address_was_imputed FROM {sales} LEFT JOIN donor USING (parcel_id)")
def impute_general(spark, d):
    sales = v(spark, d, "sales")
    rows, _ = impute.fill_from(sales, sales.select("unique_id", "parcel_id", "property_address"), ["parcel_id"], "property_address", condition=~F.col("sold_as_vacant"))
    return rows.select("unique_id", "property_address", "address_was_imputed")


@query("WITH donor AS (SELECT parcel_id, arg_min(property_address, unique_id) AS a FROM {sales} WHERE property_address IS NOT NULL GROUP BY 1) SELECT count_if(property_address IS NULL AND a IS NOT NULL) AS property_address_imputed, count_if(property_address IS NULL AND a IS NULL) AS property_address_missing, 0::bigint AS owner_address_imputed, count_if(owner_address IS NULL) AS owner_address_missing, count(*) AS rows FROM {sales} LEFT JOIN donor USING (parcel_id)")
def provenance_flags(spark, d):
    sales = v(spark, d, "sales")
    filled = impute.fill(sales, ["parcel_id"], *PARTIES[0]).withColumn("property_address_imputed", F.lit(False))
    return impute.summary(impute.mark_provenance(filled, sales, PARTIES), PARTIES)


@query("SELECT count_if(f1) AS f1_n, round(100.0 * count_if(f1) / count(*), 6) AS f1_pct, count_if(f2) AS f2_n, round(100.0 * count_if(f2) / count(*), 6) AS f2_pct FROM (SELECT o_orderkey % 7 = 0 AS f1, o_orderstatus = 'F' AS f2 FROM orders)")
def imputed_shares(spark, d):
    return impute.shares(t(spark, d, "orders").select((F.col("o_orderkey") % 7 == 0).alias("f1"), (F.col("o_orderstatus") == "F").alias("f2")), ["f1", "f2"])


# --- validation and typing ----------------------------------------------------------------------

PRICE_TEXT = "CASE WHEN p_partkey % 40 = 0 THEN '-5' WHEN p_partkey % 41 = 0 THEN '' WHEN p_partkey % 43 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN '$' || '1,' || cast(p_partkey % 900 + 100 AS string) || '.50' ELSE cast(p_retailprice AS string) END"


@query(f"SELECT count_if(NOT regexp_matches(replace(x, ',', ''), '^\\s*\\$?\\s*\\d+(\\.\\d+)?\\s*$')) AS bad_price, count_if(flag NOT IN ('Yes', 'Y', 'No', 'N')) AS bad_vacant FROM (SELECT {PRICE_TEXT} AS x, CASE p_size % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Y' WHEN 2 THEN 'No' WHEN 3 THEN 'N' WHEN 4 THEN 'maybe' END AS flag FROM part)")
def validate_counts(spark, d):
    rows = fixtures.read(spark, d, f"SELECT {PRICE_TEXT} AS x, CASE p_size % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Y' WHEN 2 THEN 'No' WHEN 3 THEN 'N' WHEN 4 THEN 'maybe' END AS flag FROM {{part}}")
    return validate.bad_counts(rows, {"bad_price": V.bad_price(F.col("x")), "bad_vacant": ~F.col("flag").isin("Yes", "Y", "No", "N")})


@query(f"SELECT p_partkey, cast(nullif(regexp_extract(replace(x, ',', ''), '\\d+(?:\\.\\d+)?'), '') AS double) AS price FROM (SELECT p_partkey, {PRICE_TEXT} AS x FROM part)")
def parse_price_text(spark, d):
    return fixtures.read(spark, d, f"SELECT p_partkey, {PRICE_TEXT} AS x FROM {{part}}").select("p_partkey", V.parse_price(F.col("x")).cast("double").alias("price"))


@query("SELECT l_orderkey, l_linenumber, count_if(b) AS yes, count_if(NOT b) AS no, count_if(b IS NULL) AS unknown FROM (SELECT *, CASE WHEN f IN ('Yes', 'Y') THEN true WHEN f IN ('No', 'N') THEN false END AS b FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'N' END AS f FROM lineitem)) GROUP BY 1, 2")
def yes_no_boolean(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", "N")
    b = F.col("b")
    return t(spark, d, "lineitem").withColumn("b", X.yes_no(flag)).groupBy("l_orderkey", "l_linenumber").agg(F.count_if(b).alias("yes"), F.count_if(~b).alias("no"), F.count_if(b.isNull()).alias("unknown"))


@query("SELECT p_partkey, regexp_replace(replace(p_name, ' ', '   '), ' {2,}', ' ', 'g') AS p_name, p_brand FROM part")
def collapse_spaces(spark, d):
    return collapse(t(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("   ")).alias("p_name"), "p_brand"))


@query("SELECT o_orderkey, cast(cast(o_orderdate AS date) AS string) AS sale_date FROM orders")
def text_to_date(spark, d):
    """Each spelling in turn, the last one a date and time."""
    spellings = [*V.DATE_FORMATS, "yyyy-MM-dd HH:mm:ss"]
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(spellings) == k, F.date_format("o_orderdate", f)) for k, f in enumerate(spellings)])
    return t(spark, d, "orders").select("o_orderkey", V.parse_date(text).cast("string").alias("sale_date"))


@query("SELECT unique_id, 'USD' AS currency_code, upper(owner_name) AS renamed FROM {sales}")
def rename_and_constant(spark, d):
    from plotwright.operators.clean import rename

    raw = v(spark, d, "sales").select(F.col("unique_id").alias("UniqueID"), F.upper("owner_name").alias("OwnerName"))
    return rename(raw).select("unique_id", F.lit("USD").alias("currency_code"), F.col("owner_name").alias("renamed"))


@query("SELECT o_orderkey, count(*) AS rows FROM (SELECT o_custkey % 50 AS o_orderkey FROM orders) GROUP BY 1 HAVING count(*) > 1 OR o_orderkey IS NULL")
def key_faults(spark, d):
    return validate.key_faults(t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("o_orderkey")), ["o_orderkey"])


@query("SELECT mapping_id FROM {mappings} m WHERE NOT EXISTS (SELECT 1 FROM {addresses} a WHERE a.address_id = m.address_id AND a.latitude IS NOT NULL)")
def foreign_key_orphans(spark, d):
    return validate.orphans(v(spark, d, "mappings"), v(spark, d, "addresses").where("latitude is not null"), {"address_id": "address_id"}).select("mapping_id")


@query("SELECT row_number() OVER () AS ordinal, column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS data_type, \"null\" = 'YES' AS is_nullable FROM (DESCRIBE orders)")
def catalog_columns(spark, d):
    return tables.columns_of(t(spark, d, "orders")).withColumn("ordinal", F.col("ordinal").cast("long"))


# --- addresses ----------------------------------------------------------------------------------


def standardized_sql(text: str) -> str:
    out = f"upper({text})"
    for short, long in A.STREET_TYPES.items():
        out = f"regexp_replace(replace(replace({out}, ' {short},', ' {long},'), ' {short} ', ' {long} '), ' {short}$', ' {long}')"
    for short, long in A.DIRECTIONS.items():
        out = f"replace({out}, ' {short} ', ' {long} ')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"SELECT unique_id, {standardized_sql('owner_address')} AS standardized FROM {{sales}}")
def standardize_abbrev(spark, d):
    return v(spark, d, "sales").select("unique_id", A.standardize_abbreviations(F.col("owner_address")).alias("standardized"))


PARSED = "SELECT unique_id, CASE WHEN regexp_matches({0}, '^\\s*(\\d+(?:-\\d+)?)\\s') THEN regexp_extract({0}, '^\\s*(\\d+(?:-\\d+)?)\\s', 1) END AS house_number, trim(split_part(regexp_replace({0}, '^\\s*\\d+(?:-\\d+)?\\s+', ''), ',', 1)) AS street_name, CASE WHEN contains({0}, ',') THEN trim(split_part({0}, ',', 2)) END AS city FROM {{sales}} WHERE {0} IS NOT NULL".replace("{0}", "owner_address").replace("{{", "{").replace("}}", "}")


@query(PARSED)
def parse_components(spark, d):
    return v(spark, d, "sales").where("owner_address is not null").select("unique_id", A.components(F.col("owner_address")).alias("c")).select("unique_id", "c.house_number", "c.street_name", "c.city")


@query(PARSED)
def parse_components_lateral(spark, d):
    A.register_sql(spark)
    return spark.sql("SELECT unique_id, p.house_number, p.street_name, p.city FROM {s}, LATERAL parse_address_components(owner_address) p", s=v(spark, d, "sales").where("owner_address is not null"))


@query("SELECT unique_id, trim(regexp_replace(property_address, '[0-9 ]+', '', 'g')) AS cleaned, cast(length(property_address) - length(regexp_replace(property_address, '[AE]', '', 'g')) AS bigint) AS counted, 'TN' AS state, cast(length(regexp_replace(property_address, '[^ ]+', '', 'g')) AS bigint) AS blanks FROM {sales}")
def text_helpers(spark, d):
    c = F.col("property_address")
    return v(spark, d, "sales").select("unique_id", X.clean_all(c, "[0-9 ]+").alias("cleaned"), X.count_substring(c, "AE").cast("long").alias("counted"), X.normalize_state(c).alias("state"), X.spaces(c).cast("long").alias("blanks"))


@query("SELECT p_partkey, '\"' || p_name || '\", \"' || p_brand || '\"' AS quoted FROM part")
def quoted_names(spark, d):
    return t(spark, d, "part").select("p_partkey", X.quoted_columns(F.array("p_name", "p_brand")).alias("quoted"))


@query("SELECT address_id, full_address FROM (SELECT address_id, CASE WHEN regexp_matches(a, '(?i)\\bTN\\b|\\bTennessee\\b') THEN a ELSE a || ', TN' END AS full_address FROM (SELECT address_id, CASE WHEN city IS NULL THEN address ELSE address || ', ' || city END AS a, latitude FROM (SELECT address_id, coalesce(address_standardized, address) AS address, city, latitude FROM {addresses})) WHERE latitude IS NULL)")
def pending_addresses(spark, d):
    return geocode.pending(v(spark, d, "addresses"))


@query("SELECT unique_id, regexp_matches(owner_address, '(?i)\\bTN\\b|\\bTennessee\\b') AS names_state, CASE WHEN owner_address IS NOT NULL THEN owner_address || coalesce(', ' || nullif(owner_name, ''), '') END AS original FROM {sales}")
def state_and_original(spark, d):
    return v(spark, d, "sales").select("unique_id", X.mentions_tennessee(F.col("owner_address")).alias("names_state"), X.original_address(F.col("owner_address"), F.col("owner_name")).alias("original"))


# --- likeness -----------------------------------------------------------------------------------

LOST = "SELECT p_partkey AS unique_id, p_brand AS parcel_id, CASE WHEN p_partkey % 3 = 0 THEN cast(p_partkey % 20 AS string) || ' ' || replace(p_name, ' ', '') ELSE cast(p_partkey % 20 AS string) || ' ' || p_name END AS property_address FROM {part}"
SQUEEZE = "regexp_replace({0}, '[0-9 ]+', '', 'g')"
BARE = "trim(regexp_replace({0}, '[0-9]+', '', 'g'))"


@query(
    f"WITH x AS ({LOST}), y AS (SELECT *, length(property_address) - length(replace(property_address, ' ', '')) AS sp FROM x), "
    "pairs AS (SELECT a.unique_id, b.unique_id AS donor_key, a.property_address AS old_text, b.property_address AS new_text, row_number() OVER (PARTITION BY a.unique_id ORDER BY b.sp DESC, b.unique_id) AS rn FROM y a JOIN y b ON a.parcel_id = b.parcel_id AND a.unique_id <> b.unique_id WHERE a.sp < b.sp "
    f"AND levenshtein({BARE.format('a.property_address')}, {BARE.format('b.property_address')}) > 0 AND levenshtein({BARE.format('a.property_address')}, {BARE.format('b.property_address')}) / greatest(length(a.property_address), length(b.property_address)) < 0.5 "
    f"AND levenshtein({SQUEEZE.format('a.property_address')}, {SQUEEZE.format('b.property_address')}) = 0) SELECT unique_id, donor_key, old_text, new_text FROM pairs WHERE rn = 1"
)
def fuzzy_pairs(spark, d):
    return fuzzy.spaced_siblings(fixtures.read(spark, d, LOST), "parcel_id", "property_address", "unique_id")


LETTERS = "SELECT c_custkey, cast(c_custkey AS string) || CASE c_custkey % 4 WHEN 0 THEN ' AB STREET' WHEN 1 THEN ' BCREEK RD' WHEN 2 THEN ' CBELL B ST' ELSE ' AX ' || c_mktsegment END AS a FROM {customer}"


@query(f"SELECT c_custkey, regexp_replace(a, '(\\d+ [ABC])(\\w) ', '\\1 \\2 ', 'g') AS letters, regexp_replace(a, '(\\d+ [BC])([BC]\\w+)', '\\1 \\2', 'g') AS initials FROM ({LETTERS})")
def split_letters(spark, d):
    return fixtures.read(spark, d, LETTERS).select("c_custkey", fuzzy.split_letters(F.col("a")).alias("letters"), fuzzy.split_initials(F.col("a")).alias("initials"))


CREEK = "SELECT unique_id, CASE WHEN unique_id % 6 = 0 THEN '1 FALL CREEK DR, X' ELSE property_address END AS p, owner_address AS o FROM {sales}"


@query(f"SELECT unique_id, CASE WHEN p LIKE '%FALL CREEK DR%' AND o IS NOT NULL THEN regexp_replace(o, ',\\s*TN\\s*$', '') ELSE p END AS property_address FROM ({CREEK})")
def repair_from_owner(spark, d):
    return fixtures.read(spark, d, CREEK).select("unique_id", fuzzy.street_from_owner(F.col("p"), F.col("o")).alias("property_address"))


TWO = "SELECT c_custkey AS unique_id, cast(c_custkey % 90 AS string) || ' ' || CASE c_custkey % 3 WHEN 0 THEN 'ROSE HILL' ELSE 'ROSEHILL' END || ' CT, ' || c_mktsegment AS property_address, cast(c_custkey % 90 AS string) || ' ' || CASE c_custkey % 5 WHEN 0 THEN 'ROSE HILL' WHEN 1 THEN 'OTHER' ELSE 'ROSEHILL' END || ' CT, ' || c_mktsegment || ', TN' AS owner_address FROM {customer}"
GROUP = "trim(regexp_extract({0}, '(^[A-Z ]+[A-Z0-9 ]+| [A-Z0-9-]+[A-ZA-Z0-9 ]+|^[0-9]{{1,2}}[A-Z ]+),', 1))"


@query(
    f"WITH x AS ({TWO}), g AS (SELECT *, {GROUP.format('property_address')} AS ga, {GROUP.format('owner_address')} AS gb FROM x), y AS (SELECT *, length(ga) <> length(gb) AND levenshtein(ga, gb) / greatest(length(ga), length(gb)) < 0.5 AND levenshtein(ga, gb) > 0 AND replace(ga, ' ', '') = replace(gb, ' ', '') AS alike FROM g) "
    "SELECT unique_id, CASE WHEN alike AND length(ga) < length(gb) THEN owner_address ELSE property_address END AS property_address, CASE WHEN alike AND length(ga) > length(gb) THEN property_address ELSE owner_address END AS owner_address FROM y"
)
def reconcile_addresses(spark, d):
    return fuzzy.reconcile(fixtures.read(spark, d, TWO))


KNOWN = "SELECT c_custkey AS address_id, c_mktsegment || ' ' || n_name AS street_name, CASE WHEN c_custkey % 2 = 0 THEN 'RD' END AS street_suffix FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"
ASKED = "SELECT DISTINCT cast(s_suppkey % 30 AS string) || ' ' || CASE s_suppkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END || ' ' || n_name || ', X' AS address FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"


@query(
    f"WITH k AS ({KNOWN}), a AS ({ASKED}), p AS (SELECT address, trim(regexp_replace(split_part(address, ',', 1), '[0-9.]+', '', 'g')) AS part FROM a), q AS (SELECT *, trim(regexp_replace(concat_ws(' ', street_name, nullif(street_suffix, '')), '[0-9]+', '', 'g')) AS name FROM k), "
    "s AS (SELECT p.address, q.address_id, 1 - levenshtein(lower(part), lower(name)) / greatest(length(part), length(name)) AS confidence FROM p JOIN q ON len(list_filter(string_split(lower(part), ' '), lambda w: w <> '' AND NOT contains(lower(street_name), w))) = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY confidence DESC, address_id) AS rn FROM s WHERE confidence >= 0.8) SELECT address, address_id AS matched_address_id, round(confidence, 9) AS confidence FROM r WHERE rn = 1"
)
def match_address(spark, d):
    found = fuzzy.match(fixtures.read(spark, d, ASKED), fixtures.read(spark, d, KNOWN), 0.8)
    return found.select("address", "matched_address_id", F.round("confidence", 9).alias("confidence"))


# --- address dimension --------------------------------------------------------------------------

CANDIDATES = "SELECT address, min(city) AS city FROM (SELECT nullif(upper(trim(split_part(property_address, ',', 1))), '') AS address, nullif(upper(trim(split_part(property_address, ',', 2))), '') AS city FROM {sales} UNION ALL SELECT nullif(upper(trim(split_part(owner_address, ',', 1))), ''), nullif(upper(trim(split_part(owner_address, ',', 2))), '') FROM {sales}) WHERE address IS NOT NULL GROUP BY address"


def seeded(spark: SparkSession, d: str) -> DataFrame:
    """A cache that knows some of the addresses already, with cities of its own."""
    some = cache.candidates(v(spark, d, "sales")).where(F.col("address").rlike("^[1-3]"))
    return tables.add_columns(cache.numbered(some.withColumn("city", F.lit("OLD")), ["address"], "address_id", 0), ADDRESS_SCHEMA).select(*[f.name for f in ADDRESS_SCHEMA])


UPSERTED = f"WITH c AS ({CANDIDATES}), old AS (SELECT row_number() OVER (ORDER BY address) AS address_id, address, 'OLD' AS city FROM c WHERE regexp_matches(address, '^[1-3]')), fresh AS (SELECT row_number() OVER (ORDER BY address) + (SELECT max(address_id) FROM old) AS address_id, address, city FROM c WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.address = c.address)), every AS (SELECT *, NULL AS address_hash FROM old UNION ALL SELECT *, md5(address) FROM fresh)"


@query(f"{UPSERTED} SELECT address_id, address, city, address_hash FROM every")
def upsert_new_addresses(spark, d):
    return cache.upsert(seeded(spark, d), v(spark, d, "sales")).select("address_id", "address", "city", "address_hash")


@query(
    f"{UPSERTED}, m AS (SELECT unique_id AS housing_id, address_id, 'property' AS address_type FROM {{sales}} JOIN every ON address = upper(trim(split_part(property_address, ',', 1))) UNION ALL SELECT unique_id, address_id, 'owner' FROM {{sales}} JOIN every ON address = upper(trim(split_part(owner_address, ',', 1)))) SELECT row_number() OVER (ORDER BY housing_id, address_type) AS mapping_id, * FROM m"
)
def mapping_rebuild(spark, d):
    sales = v(spark, d, "sales")
    return cache.mappings(sales, cache.upsert(seeded(spark, d), sales))


@query("SELECT DISTINCT a.address_id FROM {addresses} a JOIN {mappings} m ON a.address_id = m.address_id WHERE m.address_type = 'owner' AND (latitude IS NULL OR longitude IS NULL)")
def distinct_ids(spark, d):
    return cache.mapped_ids(v(spark, d, "mappings"), v(spark, d, "addresses"), "owner", pending=True)


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def md5_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("hash"))


# --- export and map -----------------------------------------------------------------------------

JOINED = "SELECT s.unique_id, s.property_address, p.latitude AS property_latitude, p.geocode_source AS property_geocode_source, {0} AS owner_latitude, {1} AS owner_geocode_source FROM {sales} s LEFT JOIN {mappings} pm ON pm.housing_id = s.unique_id AND pm.address_type = 'property' LEFT JOIN {addresses} p ON p.address_id = pm.address_id LEFT JOIN {mappings} om ON om.housing_id = s.unique_id AND om.address_type = 'owner' LEFT JOIN {addresses} o ON o.address_id = om.address_id"
PICKED = ["unique_id", "property_address", "property_latitude", "property_geocode_source", "owner_latitude", "owner_geocode_source"]


def exported(spark: SparkSession, d: str) -> DataFrame:
    return marts.export_rows(v(spark, d, "sales"), v(spark, d, "mappings"), v(spark, d, "addresses"), ["unique_id", "property_address", "sold_as_vacant", "acreage"])


@query(JOINED.replace("{0}", "o.latitude").replace("{1}", "o.geocode_source"))
def export_join(spark, d):
    return exported(spark, d).select(*PICKED)


@query(JOINED.replace("{0}", "CAST(NULL AS double)").replace("{1}", "CAST(NULL AS string)"))
def export_public(spark, d):
    return tables.redacted(exported(spark, d), OWNER_COLUMNS).select(*PICKED)


@query("SELECT cast(unique_id AS string) AS unique_id, coalesce(property_address, '') AS property_address, CASE WHEN sold_as_vacant THEN 't' ELSE 'f' END AS sold_as_vacant, coalesce(cast(acreage AS string), '') AS acreage FROM {sales}")
def csv_cells(spark, d):
    return tables.rendered(v(spark, d, "sales").select("unique_id", "property_address", "sold_as_vacant", "acreage"))


@query("SELECT unique_id, coalesce(property_address, '') AS property_address FROM {sales}")
def csv_round_trip(spark, d):
    from plotwright.storage import settle

    base = spark.sparkContext._jsc.sc().getCheckpointDir()
    settle(spark.range(1))
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/csv-{uuid.uuid4().hex}"
    tables.write_csv(v(spark, d, "sales").select("unique_id", "property_address").orderBy("unique_id"), path, single=False)
    from plotwright.schemas import fields

    read = tables.read_csv(spark, path, fields("unique_id long, property_address string"))
    return read.select("unique_id", F.coalesce("property_address", F.lit("")).alias("property_address"))


@query("SELECT unique_id, address_id, sale_price, latitude FROM (SELECT s.unique_id, a.address_id, s.sale_price, a.latitude, row_number() OVER (PARTITION BY s.unique_id ORDER BY s.sale_price DESC, a.address_id) AS rn FROM {sales} s JOIN {mappings} m ON m.housing_id = s.unique_id JOIN {addresses} a ON a.address_id = m.address_id WHERE m.address_type = 'property' AND latitude IS NOT NULL AND longitude IS NOT NULL AND sale_price IS NOT NULL) WHERE rn = 1 ORDER BY unique_id LIMIT 60000")
def map_rows(spark, d):
    return marts.map_rows(v(spark, d, "sales"), v(spark, d, "mappings"), v(spark, d, "addresses")).select("unique_id", "address_id", "sale_price", "latitude")


@query("SELECT round(avg(latitude), 6) AS center_lat, round(avg(longitude), 6) AS center_lng, min(sale_price) AS price_min, max(sale_price) AS price_max, round(avg(sale_price), 4) AS price_avg, count(*) AS n FROM {sales} s JOIN {mappings} m ON m.housing_id = s.unique_id AND m.address_type = 'property' JOIN {addresses} a ON a.address_id = m.address_id WHERE latitude IS NOT NULL AND sale_price IS NOT NULL")
def map_summary(spark, d):
    one = marts.map_summary(marts.map_rows(v(spark, d, "sales"), v(spark, d, "mappings"), v(spark, d, "addresses"), limit=2**31 - 1))
    return one.select(F.round("center_lat", 6).alias("center_lat"), F.round("center_lng", 6).alias("center_lng"), "price_min", "price_max", F.round("price_avg", 4).alias("price_avg"), "n")


@query("SELECT unique_id, coalesce(NULL, property_address) AS display_address, CASE WHEN sale_date IS NULL THEN 'Unknown' ELSE strftime(sale_date, '%b %d, %Y') END AS sold, coalesce(cast(cast(bedrooms AS int) AS string), 'N/A') AS bedrooms, CASE WHEN rooms > 0 THEN cast(rooms AS string) ELSE 'N/A' END AS bathrooms, coalesce(cast(cast(year_built AS int) AS string), 'N/A') AS year_built, coalesce(format('{:.2f}', acreage), 'N/A') AS acreage, coalesce('$' || format('{:,}', cast(land_value AS bigint)), 'N/A') AS total_value, '$' || format('{:,}', cast(sale_price AS bigint)) AS price FROM (SELECT *, coalesce(full_bath, 0) + coalesce(half_bath, 0) * 0.5 AS rooms FROM {sales})")
def map_popups(spark, d):
    return marts.popups(v(spark, d, "sales").withColumns({"address_standardized": F.lit(None).cast("string"), "total_value": F.col("land_value")}))


NICE = "CASE WHEN {0} <= 0 THEN 0.0 ELSE round_even({0} / pow(10, floor(log10({0})) - 1), 0) * pow(10, floor(log10({0})) - 1) END"


def buckets_sql(key: str, price: str, table: str) -> str:
    q = [f"quantile_cont({price}, {p})" for p in (0.25, 0.5, 0.75)]
    return f"WITH q AS (SELECT {q[0]} AS a, {q[1]} AS b, {q[2]} AS c FROM {table}), n AS (SELECT *, {NICE.format('a')} AS na, {NICE.format('b')} AS nb, {NICE.format('c')} AS nc FROM q), w AS (SELECT CASE WHEN na = nb OR nb = nc THEN [a, b, c] ELSE [na, nb, nc] END AS breaks FROM n) SELECT {key}, cast(len(list_filter(breaks, lambda x: x <= {price})) AS bigint) AS price_bucket FROM {table}, w"


@query(buckets_sql("p_partkey", "p_retailprice", "part"))
def price_buckets(spark, d):
    return marts.bucketed(t(spark, d, "part"), "p_retailprice").select("p_partkey", L("price_bucket"))


@query(buckets_sql("p_partkey", "near", "(SELECT p_partkey, 1000 + (p_retailprice - 900) / 10 AS near FROM part)"))
def price_buckets_fallback(spark, d):
    near = t(spark, d, "part").select("p_partkey", (1000 + (F.col("p_retailprice") - 900) / 10).alias("near"))
    return marts.bucketed(near, "near").select("p_partkey", L("price_bucket"))


@query("SELECT round(latitude, 1) AS cell_lat, round(longitude, 1) AS cell_lng, count(*) AS n, median(sale_price) AS median_price, cast(len(list_filter([100000, 200000, 300000], lambda x: x <= median(sale_price))) AS bigint) AS price_bucket FROM (SELECT floor(latitude * 2) / 2 AS latitude, floor(longitude * 2) / 2 AS longitude, sale_price FROM {sales} s JOIN {mappings} m ON m.housing_id = s.unique_id AND m.address_type = 'property' JOIN {addresses} a ON a.address_id = m.address_id WHERE latitude IS NOT NULL AND sale_price IS NOT NULL) GROUP BY 1, 2")
def median_by_group(spark, d):
    rows = marts.map_rows(v(spark, d, "sales"), v(spark, d, "mappings"), v(spark, d, "addresses"), limit=2**31 - 1)
    half = rows.withColumns({c: F.floor(F.col(c) * 2) / 2 for c in ("latitude", "longitude")})
    return marts.clusters(half, F.array(*[F.lit(x) for x in (100000.0, 200000.0, 300000.0)]), 1).withColumn("price_bucket", F.col("price_bucket").cast("long"))


# --- states, counts, top rows -------------------------------------------------------------------


@query("SELECT count(*) AS total_addresses, count_if(latitude IS NOT NULL AND longitude IS NOT NULL) AS geocoded_count, count_if(latitude IS NULL OR longitude IS NULL) AS not_geocoded_count, count_if(geocode_source = 'OSM') AS osm_count, count_if(geocode_source = 'HERE') AS here_count, cast(cast(count_if(latitude IS NOT NULL AND longitude IS NOT NULL) * 100.0 / nullif(count(*), 0) AS decimal(5, 2)) AS double) AS geocoded_percentage FROM {addresses}")
def status_summary(spark, d):
    return marts.status(v(spark, d, "addresses")).withColumn("geocoded_percentage", F.col("geocoded_percentage").cast("double"))


@query("SELECT total, geocoded, failed, corrected, pending, round(mean, 9) AS mean_confidence, format('{} ({:.1f}%)', geocoded, 100.0 * geocoded / total) AS geocoded_label FROM (SELECT count(*) AS total, count_if(geocode_status = 'GEOCODED') AS geocoded, count_if(geocode_status = 'FAILED') AS failed, count_if(geocode_status = 'MANUALLY_CORRECTED') AS corrected, count_if(geocode_status IS NULL) AS pending, avg(geocode_confidence) AS mean FROM {addresses})")
def dashboard_stats(spark, d):
    return marts.dashboard(v(spark, d, "addresses")).select("total", "geocoded", "failed", "corrected", "pending", F.round("mean_confidence", 9).alias("mean_confidence"), "geocoded_label")


@query("SELECT geocode_source, geocode_status, count(*) AS n FROM {addresses} GROUP BY 1, 2")
def group_counts(spark, d):
    return marts.by_source(v(spark, d, "addresses"))


@query("SELECT address_id FROM {addresses} ORDER BY geocoded_at DESC NULLS LAST, address_id LIMIT 100")
def topk_recent(spark, d):
    return geocode.listed(v(spark, d, "addresses"), limit=100).select("address_id")


@query("SELECT address_id FROM {addresses} WHERE geocode_status = 'FAILED' ORDER BY geocoded_at DESC NULLS FIRST, address_id LIMIT 100")
def topk_recent_nulls_first(spark, d):
    return geocode.recent_results(v(spark, d, "addresses"), "FAILED").select("address_id")


@query("SELECT c_custkey FROM customer WHERE 34 + c_acctbal / 3000 BETWEEN 35.0 AND 36.7 AND -88 + c_custkey % 300 / 100 BETWEEN -87.6 AND -85.7")
def bbox_filter(spark, d):
    return t(spark, d, "customer").where(V.in_bounds(34 + F.col("c_acctbal") / 3000, -88 + (F.col("c_custkey") % 300) / 100)).select("c_custkey")


@query("SELECT address_id, coalesce(geocode_status = 'FAILED', false) OR latitude IS NULL OR longitude IS NULL AS attention, round(longitude, 6) AS lon, round(latitude, 6) AS lat, latitude IS NOT NULL AND longitude IS NOT NULL AS placed FROM {addresses}")
def attention_and_points(spark, d):
    """The places as read back from the points' text, longitude first."""
    lat, lng = F.col("latitude"), F.col("longitude")
    text = V.ewkt(V.point(lat, lng))
    number = lambda k: F.round(F.regexp_extract(text, r"^SRID=4326;POINT\((\S+) (\S+)\)$", k).try_cast("double"), 6)
    return v(spark, d, "addresses").select("address_id", V.needs_attention(F.col("geocode_status"), lat, lng).alias("attention"), number(1).alias("lon"), number(2).alias("lat"), text.isNotNull().alias("placed"))


@query("SELECT unique_id, property_address AS address1, 'placeholder_address' AS issue_type FROM {sales} WHERE regexp_matches(property_address, '^0( |$)') AND owner_name IS NOT NULL")
def placeholder_issues(spark, d):
    sales = v(spark, d, "sales")
    listed = sales.where("owner_name is null").select("unique_id", F.lit(None).cast("string").alias("address1"), F.lit(None).cast("string").alias("address2"), F.lit(quality.ISSUE).alias("issue_type"))
    return quality.placeholder_issues(sales, listed).select("unique_id", "address1", "issue_type")


@query("SELECT (SELECT count(*) FROM {sales}) AS sales, (SELECT count(*) FROM (SELECT 1 FROM {sales} GROUP BY parcel_id, property_address HAVING count(*) > 1)) AS duplicate_groups, (SELECT count(*) FROM {sales} WHERE regexp_matches(property_address, '^0( |$)')) AS issues")
def issue_overview(spark, d):
    sales = v(spark, d, "sales")
    return quality.overview(sales, quality.placeholder_issues(sales, spark.createDataFrame([], ISSUES)), ["parcel_id", "property_address"])


@query("SELECT event_type AS issue_type, count(*) AS n FROM events GROUP BY 1")
def issues_by_type(spark, d):
    return quality.by_type(t(spark, d, "events").select(F.col("event_type").alias("issue_type")))


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_difference(spark, d):
    return t(spark, d, "orders").select("o_custkey").subtract(t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


# --- profiles -----------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT 'property_address' AS column_name, count_if(property_address IS NULL) AS missing, round(100.0 * count_if(property_address IS NULL) / count(*), 6) AS missing_pct, count(DISTINCT property_address) AS unique_values, count_if(property_address = '') AS empty_strings, count_if(NOT regexp_matches(property_address, '\\d')) AS no_house_number FROM {sales} UNION ALL SELECT 'owner_name', count_if(owner_name IS NULL), round(100.0 * count_if(owner_name IS NULL) / count(*), 6), count(DISTINCT owner_name), count_if(owner_name = ''), NULL FROM {sales})")
def profile_text(spark, d):
    return profile.columns(v(spark, d, "sales").select("property_address", "owner_name")).select("column_name", "missing", F.round("missing_pct", 6).alias("missing_pct"), "unique_values", "empty_strings", "no_house_number")


@query("SELECT 'l_quantity' AS column_name, count_if(l_quantity IS NULL) AS missing, count(DISTINCT l_quantity) AS unique_values, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 4) AS mean, count_if(l_quantity = 0) AS zeros, count_if(l_quantity < 0) AS negatives FROM lineitem UNION ALL SELECT 'l_discount', count_if(l_discount IS NULL), count(DISTINCT l_discount), min(l_discount), max(l_discount), round(avg(l_discount), 4), count_if(l_discount = 0), count_if(l_discount < 0) FROM lineitem")
def profile_numeric(spark, d):
    return profile.columns(t(spark, d, "lineitem").select("l_quantity", "l_discount")).select("column_name", "missing", "unique_values", "min", "max", F.round("mean", 4).alias("mean"), "zeros", "negatives")


@query("SELECT round((count_if(property_address IS NULL) + count_if(owner_name IS NULL) + count_if(acreage IS NULL)) * 100.0 / count(*) / 3, 6) AS mean_missing_pct FROM {sales}")
def completeness(spark, d):
    return profile.completeness(v(spark, d, "sales").select("property_address", "owner_name", "acreage")).select(F.round("mean_missing_pct", 6).alias("mean_missing_pct"))


@query("SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, round(quantile_cont(o_totalprice, 0.95), 4) AS q95, max(o_totalprice) AS max, count_if(o_totalprice IS NULL) AS missing FROM orders")
def numeric_summary(spark, d):
    out = profile.numeric_summary(t(spark, d, "orders"), ["o_totalprice"])
    return out.select("column_name", "count", *[F.round(c, 4).alias(c) if c not in ("min", "max") else F.col(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "q95", "max")], "missing")


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def iqr_outliers(spark, d):
    return profile.outliers(t(spark, d, "events"), "value").select("event_id", "value")


@query("SELECT coalesce(bedrooms_text, '(missing)') AS value, count(*) AS n FROM (SELECT CASE WHEN unique_id % 8 = 0 THEN NULL ELSE cast(unique_id % 37 AS string) END AS bedrooms_text FROM {sales}) GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def value_counts_top20(spark, d):
    return profile.value_counts(v(spark, d, "sales").select(F.when(F.col("unique_id") % 8 != 0, F.col("unique_id") % 37).alias("x")), "x")


@query("SELECT cast(floor(length(property_address) / 5) + 1 AS bigint) AS bin, count(*) AS n FROM {sales} WHERE property_address IS NOT NULL GROUP BY 1")
def length_histogram(spark, d):
    return profile.histogram(v(spark, d, "sales"), F.length("property_address"), 0, 100, 20)


@query("SELECT a, b, round(corr, 9) AS corr FROM (SELECT 'acreage' AS a, 'land_value' AS b, corr(x, y) AS corr FROM (SELECT cast(acreage IS NULL AS int) AS x, cast(land_value IS NULL AS int) AS y FROM {sales}) UNION ALL SELECT 'acreage', 'bedrooms', corr(x, y) FROM (SELECT cast(acreage IS NULL AS int) AS x, cast(bedrooms IS NULL AS int) AS y FROM {sales}) UNION ALL SELECT 'land_value', 'bedrooms', corr(x, y) FROM (SELECT cast(land_value IS NULL AS int) AS x, cast(bedrooms IS NULL AS int) AS y FROM {sales}))")
def missing_corr(spark, d):
    return profile.missing_correlation(v(spark, d, "sales").select("acreage", "land_value", "bedrooms", "land_use")).where("a != b").select("a", "b", F.round("corr", 9).alias("corr"))


@query("SELECT 'acreage,land_value' AS columns, count_if(acreage IS NULL AND land_value IS NULL) AS rows_missing_all, round_even(100.0 * count_if(acreage IS NULL AND land_value IS NULL) / count(*), 1) AS pct FROM {sales} UNION ALL SELECT 'bedrooms,full_bath', count_if(bedrooms IS NULL AND full_bath IS NULL), round_even(100.0 * count_if(bedrooms IS NULL AND full_bath IS NULL) / count(*), 1) FROM {sales}")
def missing_blocks(spark, d):
    out = profile.missing_blocks(v(spark, d, "sales").select("acreage", "land_value", "bedrooms", "full_bath", "half_bath", "land_use"))
    return out.select(F.array_join("columns", ",").alias("columns"), "rows_missing_all", "pct")


@query("SELECT round(100.0 * count_if(regexp_matches(property_address, '\\d')) / count(property_address), 6) AS with_digit_pct, round(100.0 * count_if(contains(property_address, ',')) / count(property_address), 6) AS with_city_pct, count_if(regexp_matches(property_address, '^0( |$)')) AS placeholders, round(100.0 * count_if(property_address IS NULL) / count(*), 6) AS missing_pct FROM {sales}")
def address_quality(spark, d):
    out = profile.address_quality(v(spark, d, "sales"), "property_address")
    return out.select(F.round("with_digit_pct", 6).alias("with_digit_pct"), F.round("with_city_pct", 6).alias("with_city_pct"), "placeholders", F.round("missing_pct", 6).alias("missing_pct"))


@query("SELECT unique_id FROM {sales} WHERE property_address IS NOT NULL AND trim(property_address) <> '' AND length(property_address) < 27 ORDER BY unique_id LIMIT 10")
def short_address_sample(spark, d):
    return profile.short_addresses(v(spark, d, "sales"), "property_address", 27)["short"].select("unique_id")


# --- geocoding, corrections, quota --------------------------------------------------------------

def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


def full_cache(spark: SparkSession, d: str) -> DataFrame:
    return tables.add_columns(v(spark, d, "addresses").withColumn("geocoded_at", F.col("geocoded_at").cast("timestamp_ntz")), ADDRESS_SCHEMA).select(*[f.name for f in ADDRESS_SCHEMA])


@query("SELECT address_id, CASE WHEN latitude IS NOT NULL THEN latitude WHEN city IS NOT NULL THEN 36.1 END AS latitude, CASE WHEN latitude IS NOT NULL THEN geocode_status WHEN city IS NOT NULL THEN 'GEOCODED' ELSE 'FAILED' END AS geocode_status, cast(CASE WHEN latitude IS NULL THEN coalesce(cast(geocoded_at AS timestamp), TIMESTAMP '2024-06-01 12:00:00') ELSE geocoded_at END AS string)[:10] AS geocoded_on FROM {addresses}")
def store_results(spark, d):
    known = full_cache(spark, d)
    ok = F.col("city").isNotNull()
    results = known.where("latitude is null").select("address_id", ok.alias("success"), F.when(ok, 36.1).alias("latitude"), F.when(ok, -86.7).alias("longitude"), F.col("address").alias("corrected_address"), F.lit(0.5).alias("confidence"), F.lit("OSM").alias("source"))
    return geocode.store(known, results, now()).select("address_id", "latitude", "geocode_status", F.date_format("geocoded_at", "yyyy-MM-dd").alias("geocoded_on"))


@query("SELECT address_id, 'corrected_address' AS field_changed, corrected_address AS original_value FROM {addresses} WHERE city IS NOT NULL AND corrected_address IS DISTINCT FROM CASE WHEN geocode_source = 'HERE' THEN corrected_address ELSE 'NEW' END UNION ALL SELECT address_id, 'coordinates', '(' || coalesce(cast(latitude AS string), 'None') || ', ' || coalesce(cast(longitude AS string), 'None') || ')' FROM {addresses} WHERE city IS NOT NULL AND address_standardized IS NULL AND (latitude IS DISTINCT FROM 36.0 OR longitude IS DISTINCT FROM -86.0)")
def correction_log(spark, d):
    known = full_cache(spark, d).withColumns({c: F.round(c, 2) for c in ("latitude", "longitude")})
    bare = F.col("address_standardized").isNull()
    fixes = known.where("city is not null").select("address_id", F.when(F.col("geocode_source") == "HERE", F.col("corrected_address")).otherwise("NEW").alias("corrected_address"), F.when(bare, 36.0).alias("latitude"), F.when(bare, -86.0).alias("longitude"), F.lit("me").alias("changed_by"), F.lit("why").alias("reason"))
    return geocode.correct(known, fixes, spark.createDataFrame([], CORRECTION_LOG), now())[1].select("address_id", "field_changed", "original_value")


ORACLES["correction_log"] = ORACLES["correction_log"].replace("cast(latitude AS string)", "cast(round(latitude, 2) AS string)").replace("cast(longitude AS string)", "cast(round(longitude, 2) AS string)")

WINDOWS = "WITH RECURSIVE w(event_type, started) AS (SELECT event_type, min(ts) FROM events GROUP BY 1 UNION ALL SELECT w.event_type, (SELECT min(ts) FROM events e WHERE e.event_type = w.event_type AND e.ts >= w.started + INTERVAL 24 HOURS) FROM w WHERE w.started IS NOT NULL) SELECT w.event_type, cast(epoch_us(w.started) AS bigint) AS started_us, count(*) AS request_count FROM w JOIN events e ON e.event_type = w.event_type AND e.ts >= w.started AND e.ts < w.started + INTERVAL 24 HOURS WHERE w.started IS NOT NULL GROUP BY 1, 2"


ONE_WINDOWS = WINDOWS.replace("FROM events e", "FROM one e").replace("FROM events", "FROM one").replace("JOIN events e", "JOIN one e").replace("WITH RECURSIVE ", "WITH RECURSIVE one AS (SELECT 'all' AS event_type, ts FROM events), ")


def as_table(windows: str) -> str:
    """The same windows as a table x."""
    head, body = windows.rsplit(" SELECT w.event_type, cast(", 1)
    return f"{head}, x AS (SELECT w.event_type, cast({body})"


@query(WINDOWS)
def quota_windows(spark, d):
    out = quota.windows(t(spark, d, "events"), "event_type", "ts")
    return out.select("event_type", F.unix_micros(F.col("window_started_at").cast("timestamp")).alias("started_us"), "request_count")


@query(WINDOWS)
def quota_windows_stream(spark, d):
    """The same windows from a stream in four runs over one state, so that windows stay open across them; timers close each at its end, the last by a heartbeat."""
    events = t(spark, d, "events").select("event_type", "ts")
    at = scratch(spark, "quota")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = profile.quantiles(events.select(us.alias("us")), "us", (0.25, 0.5, 0.75))
    part = sum((F.when(us > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("event_type"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
    for k in range(5):
        (events.where(part == k) if k < 4 else last).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("event_type string, ts timestamp_ntz").parquet(f"{at}/in")
        run = stream_quota.closed_windows(stream, "event_type", "ts").writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
        run.awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("key").alias("event_type"), F.unix_micros("window_started_at").alias("started_us"), "request_count")


@query(WINDOWS)
def polled_windows(spark, d):
    """Running counts as a polled refresh gets them; the last that it was shown of each window."""
    at = scratch(spark, "polled")
    t(spark, d, "events").select("event_type", "ts").write.parquet(f"{at}/in")
    stream = stream_quota.stream_windows(spark.readStream.schema("event_type string, ts timestamp_ntz").parquet(f"{at}/in"), "event_type", "ts")
    run = stream_quota.polled(stream, lambda df, k: df.write.mode("append").parquet(f"{at}/out"), f"{at}/state", "1 second")
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    shown = spark.read.parquet(f"{at}/out").groupBy(F.col("key").alias("event_type"), F.unix_micros("window_started_at").alias("started_us"))
    return shown.agg(F.max("request_count").alias("request_count"))


@query(ONE_WINDOWS)
def quota_one_key(spark, d):
    """All calls as one key's, dealt to eight tasks: successors are composed over their ranges."""
    calls = t(spark, d, "events").select(F.lit("all").alias("event_type"), "ts")
    return quota.windows(calls, "event_type", "ts", parts=8).select("event_type", F.unix_micros(F.col("window_started_at").cast("timestamp")).alias("started_us"), "request_count")


@query("SELECT event_type AS api_name, cast(cast(ts AS date) AS string) AS request_date, count(*) AS request_count FROM events GROUP BY 1, 2")
def daily_usage(spark, d):
    return quota.daily(t(spark, d, "events"), "event_type", "ts").withColumn("request_date", F.col("request_date").cast("string"))


@query("SELECT event_type AS api_name, cast(cast(ts AS date) AS string) AS request_date, 2 * count(*) AS request_count FROM events GROUP BY 1, 2")
def usage_upsert(spark, d):
    day = quota.daily(t(spark, d, "events"), "event_type", "ts").withColumn("window_started_at", F.lit(None).cast("timestamp_ntz"))
    return quota.add_usage(day, day).select("api_name", S("request_date"), "request_count")


@query("SELECT api_name, cast(request_date AS string) AS request_date, request_count FROM (SELECT event_type AS api_name, cast(ts AS date) AS request_date, count(*) AS request_count FROM events GROUP BY 1, 2) WHERE request_date < DATE '2024-01-20' ORDER BY request_date DESC, api_name LIMIT 30")
def recent_usage(spark, d):
    return quota.recent_days(quota.daily(t(spark, d, "events"), "event_type", "ts"), datetime.date(2024, 1, 20)).withColumn("request_date", F.col("request_date").cast("string"))


@query("SELECT event_id, value IS NULL OR ts >= TIMESTAMP '2024-01-02 00:00:00' OR value < 20 AS allowed FROM events")
def quota_allowed(spark, d):
    started = F.when(F.col("value").isNotNull(), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return t(spark, d, "events").select("event_id", quota.allowed(F.col("value"), started, F.col("ts"), 20).alias("allowed"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return stream_quota.tumbling(t(spark, d, "events"), "event_type", "ts").select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


@query("SELECT user_id, avg(k) AS mean_k FROM (SELECT user_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events) GROUP BY 1")
def json_fields(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.avg(F.from_json("props", "k bigint")["k"]).alias("mean_k"))


CORRECTED_TWICE = "SELECT address_id, 'first ' || address AS one, 36.0 + address_id % 7 / 10 AS lat, 'then ' || address AS two FROM {addresses} WHERE city IS NOT NULL"


@query(f"WITH c AS ({CORRECTED_TWICE}) SELECT address_id, 1 AS step, 'corrected_address' AS field_changed, corrected_address AS original_value, one AS new_value, two AS kept FROM c JOIN {{addresses}} USING (address_id) WHERE corrected_address IS DISTINCT FROM one UNION ALL SELECT address_id, 3, 'corrected_address', one, two, two FROM c")
def corrections_repeated(spark, d):
    """Two corrections of an address, in order: the second stands, both are logged. The coordinates' own entries are left out here."""
    known = full_cache(spark, d)
    two = fixtures.read(spark, d, CORRECTED_TWICE)
    fix = lambda k, text: two.select("address_id", F.col(text).alias("corrected_address"), F.col("lat").alias("latitude"), F.lit(-86.0).alias("longitude"), F.lit("me").alias("changed_by"), F.lit("why").alias("reason"), F.lit(k).alias("at"))
    after, log = geocode.correct(known, fix(2, "two").unionByName(fix(1, "one")), spark.createDataFrame([], CORRECTION_LOG), now(), order="at")
    step = F.when(F.col("new_value").startswith("first "), 1).otherwise(3).alias("step")
    return log.where("field_changed = 'corrected_address'").join(after.select("address_id", F.col("corrected_address").alias("kept")), "address_id").select("address_id", step, "field_changed", "original_value", "new_value", "kept")


@query("SELECT c_custkey AS address_id, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 100")
def recent_corrections(spark, d):
    """The log's latest entries with their addresses; ids of the log run as the corrections do."""
    base = fixtures.read(spark, d, "SELECT c_custkey AS address_id, n_name AS place, c_acctbal FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
    log = base.select(F.col("address_id").alias("id"), "address_id", F.timestamp_seconds(F.floor(F.col("c_acctbal") * 100)).alias("changed_at"))
    return geocode.recent_corrections(log, base.select("address_id", F.lit("x").alias("address"), F.col("place").alias("city"))).select("address_id", F.col("city").alias("place"))


BULK = "SELECT address_id, geocode_status, geocode_source FROM (SELECT a.address_id, CASE WHEN p.address_id IS NULL THEN a.geocode_status WHEN p.at_first THEN 'GEOCODED' WHEN p.k <= 15 THEN 'GEOCODED' ELSE a.geocode_status END AS geocode_status, CASE WHEN p.address_id IS NULL THEN a.geocode_source WHEN p.at_first THEN 'OSM' WHEN p.k <= 15 THEN 'HERE' ELSE a.geocode_source END AS geocode_source FROM {addresses} a LEFT JOIN (SELECT *, min(CASE WHEN k = 15 THEN batch END) OVER () AS last_batch FROM (SELECT address_id, at_first, floor((row_number() OVER (ORDER BY address_id) - 1) / 20) AS batch, sum(CASE WHEN at_first THEN 0 ELSE 1 END) OVER (ORDER BY address_id) AS k FROM (SELECT address_id, address_id % 3 <> 0 AS at_first FROM {addresses} WHERE latitude IS NULL))) p ON p.address_id = a.address_id AND p.batch <= coalesce(p.last_batch, p.batch))"
AT = datetime.datetime(2024, 6, 1, 12)


def starts_with_number(address: str) -> bool:
    """Of the addresses here, those that have no standardised form."""
    return address[:1].isdigit()


def chained(cutoff: int):
    """A first provider that knows standardised addresses only, and a second that knows all."""
    first = ByRule(lambda a: None if starts_with_number(a) else (36.0, -86.5))
    return lambda used: geocode.chain(first, ByRule(lambda a: (36.0, -86.5), name="HERE"), used, cutoff)


def used_before(spark: SparkSession) -> DataFrame:
    return quota.add_calls(spark.createDataFrame([], USAGE), "HERE", 5, AT - datetime.timedelta(hours=20))


@query(BULK)
def bulk_quota(spark, d):
    """Pending addresses through a chain whose second provider has 20 calls a window, 5 of them used before."""
    known = full_cache(spark, d)
    after, _, _ = geocode.bulk(known, known.select("address_id"), chained(20), now(), used_before(spark), batch_size=20, cutoff=20, clock=lambda: AT)
    return after.select("address_id", "geocode_status", "geocode_source")


class Killed(Exception):
    pass


@query(BULK)
def bulk_resumed(spark, d):
    """The same run, killed before its third batch and taken up from the answers that it kept."""
    known, log, calls = full_cache(spark, d), scratch(spark, "answers"), [0]

    def clock() -> datetime.datetime:
        calls[0] += 1
        if calls[0] == 3:
            raise Killed
        return AT

    run = lambda clock: geocode.bulk(known, known.select("address_id"), chained(20), now(), used_before(spark), batch_size=20, cutoff=20, clock=clock, log=log)
    with contextlib.suppress(Killed):
        run(clock)
    return run(lambda: AT)[0].select("address_id", "geocode_status", "geocode_source")


@query("SELECT address_id, CASE WHEN latitude IS NULL THEN 'GEOCODED' ELSE geocode_status END AS geocode_status, CASE WHEN latitude IS NOT NULL THEN geocode_source WHEN address_standardized IS NULL THEN 'HERE' ELSE 'OSM' END AS geocode_source FROM {addresses}")
def provider_lookups(spark, d):
    """All pending addresses through the lookup data source, four partitions under one rate; its clock does not wait here."""
    known = full_cache(spark, d)
    first, second = ByRule(lambda a: None if starts_with_number(a) else (36.0, -86.5)), ByRule(lambda a: (36.0, -86.5), name="HERE")
    idle = lookups.Clock(lambda: 0.0, lambda s: None)
    ask = lambda part, used: lookups.answers(part, first, second, 2**31 - used, parts=4, interval=1.1, clock=idle)
    after, _, _ = geocode.bulk(known, known.select("address_id"), chained(20), now(), batch_size=10_000, cutoff=2**31, clock=lambda: AT, ask=ask)
    return after.select("address_id", "geocode_status", "geocode_source")


@query(as_table(WINDOWS) + " SELECT event_type AS api_name, cast(cast(make_timestamp(started_us) AS date) AS string) AS request_date, cast(sum(request_count) AS bigint) AS request_count, min(started_us) AS anchor_us FROM x GROUP BY 1, 2")
def usage_by_anchor(spark, d):
    """Each window's calls count to the day on which it opened."""
    opened = quota.windows(t(spark, d, "events").select(F.col("event_type").alias("api_name"), "ts"), "api_name", "ts").withColumn("request_date", F.to_date("window_started_at"))
    out = quota.add_usage(opened.limit(0), opened)
    return out.select("api_name", S("request_date"), "request_count", F.unix_micros(F.col("window_started_at").cast("timestamp")).alias("anchor_us"))


@query(as_table(ONE_WINDOWS) + ", z AS (SELECT *, row_number() OVER (ORDER BY started_us DESC) AS k FROM x) SELECT request_count AS used, 1000 - request_count AS remaining, request_count AS today, least(30, (SELECT count(*) FROM z) - 1) AS days FROM z WHERE k = 1")
def usage_stats(spark, d):
    """The dashboard's figures when the last window opens."""
    usage = quota.windows(t(spark, d, "events").select(F.lit("HERE").alias("api_name"), "ts"), "api_name", "ts").withColumn("request_date", F.to_date("window_started_at"))
    found = quota.stats(usage, usage.agg(F.max("window_started_at")).first()[0])
    row = (found["here_window_used"], found["here_daily_remaining"], found["today_usage"]["HERE"], len(found["historical_usage"].get("HERE", [])))
    return spark.createDataFrame([row], "used long, remaining long, today long, days long")


@query("SELECT count(*) AS request_count, cast(epoch_us(max(first_ts)) AS bigint) AS started_us FROM (SELECT ts, min(ts) OVER () AS first_ts FROM events) WHERE ts < first_ts + INTERVAL 24 HOURS")
def active_window(spark, d):
    """The open window of the calls seen as one API's, an hour after its first call."""
    calls = t(spark, d, "events").select(F.lit("HERE").alias("api_name"), "ts")
    usage = quota.windows(calls, "api_name", "ts").withColumn("request_date", F.to_date("window_started_at"))
    first = usage.agg(F.min("window_started_at")).first()[0]
    used, started = quota.window_used(usage.where(F.col("window_started_at") <= F.lit(first + datetime.timedelta(hours=1))), "HERE", first + datetime.timedelta(hours=1))
    return spark.range(1).select(F.lit(used).cast("long").alias("request_count"), F.unix_micros(F.lit(started).cast("timestamp")).alias("started_us"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def rename_loose(spark, d):
    """A table whose headers were typed by hand, under the names made of them."""
    given = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    typed = given.toDF(*[c.replace("_", "  ").title() + " #" * (k % 2) for k, c in enumerate(given.columns)])
    return typed.toDF(*[X.snake_case_loose(c) for c in typed.columns])


@query("SELECT address_id, address, latitude, geocode_status FROM {addresses}")
def backup_restore(spark, d):
    """The cache as it is read back from a backup."""
    from plotwright import storage

    storage.settle(spark.range(1))
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    at = storage.backup({"addresses": full_cache(spark, d)}, f"{base}/backups-{uuid.uuid4().hex}")
    return storage.restore(spark, at, ["addresses"])["addresses"].select("address_id", "address", "latitude", "geocode_status")


# --- layouts, exports, transactions -------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE 34 + c_acctbal / 3000 BETWEEN 35.0 AND 36.7 AND -88 + c_custkey % 300 / 100 BETWEEN -87.6 AND -85.7")
def bbox_layout(spark, d):
    """The box's rows from a table laid out along the curve."""
    at = scratch(spark, "places")
    spatial.publish(t(spark, d, "customer").select("c_custkey", (34 + F.col("c_acctbal") / 3000).alias("latitude"), (-88 + (F.col("c_custkey") % 300) / 100).alias("longitude")), at, files=16)
    return spatial.in_box(spark, at).select("c_custkey")


ZOOMS = range(6, 13)
BIT = "(({0} >> {1}) & 1) << {2}"
TILE = " | ".join(f"({BIT.format('x', k, 2 * k)}) | ({BIT.format('y', k, 2 * k + 1)})" for k in range(max(ZOOMS)))


@query(
    f"WITH p AS (SELECT cast(floor((longitude - -180.0) / 360.0 * {2 ** max(ZOOMS)}) AS bigint) AS x, cast(floor((latitude - -90.0) / 180.0 * {2 ** max(ZOOMS)}) AS bigint) AS y, sale_price FROM {{sales}} s JOIN {{mappings}} m ON m.housing_id = s.unique_id AND m.address_type = 'property' JOIN {{addresses}} a ON a.address_id = m.address_id WHERE latitude IS NOT NULL AND sale_price IS NOT NULL), "
    f"c AS (SELECT {TILE} AS code, sale_price FROM p), z AS (SELECT unnest(range({min(ZOOMS)}, {max(ZOOMS) + 1})) AS zoom) "
    f"SELECT zoom, code >> (2 * ({max(ZOOMS)} - zoom))::int AS tile, count(*) AS n, median(sale_price) AS median_price, cast(len(list_filter([100000, 200000, 300000], lambda b: b <= median(sale_price))) AS bigint) AS price_bucket FROM c, z GROUP BY 1, 2"
)
def price_pyramid(spark, d):
    """Count, median price and its bucket of every tile, at seven zooms."""
    rows = marts.map_rows(v(spark, d, "sales"), v(spark, d, "mappings"), v(spark, d, "addresses"), limit=2**31 - 1)
    out = marts.pyramid(rows, ZOOMS, F.array(*[F.lit(x) for x in (100000.0, 200000.0, 300000.0)]))
    return out.select(L("zoom"), L("tile"), "n", "median_price", L("price_bucket"))


def whole_sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales with all columns of the export."""
    return v(spark, d, "sales").withColumns({"tax_district": F.lit("URBAN"), "building_value": F.col("land_value") * 2, "total_value": F.col("land_value") * 3, "currency_code": F.lit("USD")}).select(*EXPORT_COLUMNS)


WHOLE = "SELECT s.*, 'URBAN' AS tax_district, land_value * 2 AS building_value, land_value * 3 AS total_value, 'USD' AS currency_code FROM {sales} s"
SIDES = [f"{a}.{c} AS {side}_{c}" for a, side in (("p", "property"), ("o", "owner")) for c in POINT_COLUMNS]
ALL_COLUMNS = "SELECT " + ", ".join([f"s.{c}" for c in EXPORT_COLUMNS] + SIDES) + f" FROM ({WHOLE}) s LEFT JOIN {{mappings}} pm ON pm.housing_id = s.unique_id AND pm.address_type = 'property' LEFT JOIN {{addresses}} p ON p.address_id = pm.address_id LEFT JOIN {{mappings}} om ON om.housing_id = s.unique_id AND om.address_type = 'owner' LEFT JOIN {{addresses}} o ON o.address_id = om.address_id"


@query(ALL_COLUMNS)
def export_bucketed(spark, d):
    """All columns of the export, from tables bucketed by the sale."""
    name = f"export_{uuid.uuid4().hex}"
    marts.publish_bucketed(whole_sales(spark, d), v(spark, d, "mappings"), v(spark, d, "addresses"), name, scratch(spark, "buckets"), 8)
    return marts.export_bucketed(spark, name)


def cell_sql(name: str, kind: str) -> str:
    return f"CASE WHEN {name} THEN 't' WHEN NOT {name} THEN 'f' ELSE '' END" if kind == "boolean" else f"coalesce(cast({name} AS string), '')"


EXPORTED_KINDS = {"property_address_imputed": "boolean", "owner_address_imputed": "boolean", "sold_as_vacant": "boolean"}


@query(
    f"WITH e AS ({ALL_COLUMNS}) SELECT 'full' AS kind, " + ", ".join(f"{cell_sql(c, EXPORTED_KINDS.get(c, 'text'))} AS {c}" for c in EXPORTED) + " FROM e UNION ALL SELECT 'public', " + ", ".join("''" if c in OWNER_COLUMNS else cell_sql(c, EXPORTED_KINDS.get(c, "text")) for c in EXPORTED) + " FROM e"
)
def export_both(spark, d):
    """All columns of both exports, as they are read back from the files of one job."""
    at = scratch(spark, "exports")
    exports.export(marts.export_rows(whole_sales(spark, d), v(spark, d, "mappings"), v(spark, d, "addresses")), at, single=False)
    read = lambda kind: spark.read.csv(f"{at}/{kind}", header=True, quote='"', escape='"').select(F.lit(kind).alias("kind"), *[F.coalesce(c, F.lit("")).alias(c) for c in EXPORTED])
    return read("full").unionByName(read("public"))


@query("SELECT address_id, coalesce(city, 'NOWHERE') AS city, mapping_id FROM {addresses} JOIN (SELECT address_id, min(mapping_id) AS mapping_id FROM {mappings} GROUP BY 1) USING (address_id)")
def ledger_tables(spark, d):
    """Two tables of one commit, one of them replaced, from its own rows, by a second."""
    ledger = Ledger(spark, scratch(spark, "ledger"))
    ledger.commit({"addresses": v(spark, d, "addresses"), "mappings": v(spark, d, "mappings")})
    ledger.commit({"addresses": ledger.read("addresses").withColumn("city", F.coalesce("city", F.lit("NOWHERE")))})
    return ledger.read("addresses").join(ledger.read("mappings").groupBy("address_id").agg(F.min("mapping_id").alias("mapping_id")), "address_id").select("address_id", "city", "mapping_id")


@query("WITH donor AS (SELECT parcel_id, arg_min(property_address, unique_id) AS a FROM {sales} WHERE property_address IS NOT NULL GROUP BY 1) SELECT unique_id, CASE WHEN property_address IS NULL AND NOT sold_as_vacant THEN a ELSE property_address END AS property_address, property_address IS NULL AND NOT sold_as_vacant AND a IS NOT NULL AS address_was_imputed FROM {sales} LEFT JOIN donor USING (parcel_id)")
def impute_script(spark, d):
    """The general imputation as a SQL script that gets its names as text."""
    v(spark, d, "sales").createOrReplaceTempView("script_sales")
    return procedures.impute(spark, "script_sales", "script_sales", ["parcel_id"], "property_address", "NOT t.sold_as_vacant").select("unique_id", "property_address", "address_was_imputed")


def profiled(table: str, numbers: list[str], others: list[str]) -> str:
    number = lambda c: f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS missing, count(DISTINCT {c}) AS unique_values, cast(min({c}) AS double) AS min, cast(max({c}) AS double) AS max, round(avg({c}), 4) AS mean, count_if({c} = 0) AS zeros, count_if({c} < 0) AS negatives FROM {table}"
    other = lambda c: f"SELECT '{c}', count_if({c} IS NULL), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL FROM {table}"
    return " UNION ALL ".join([*map(number, numbers), *map(other, others)])


@query(profiled("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"]))
def profile_orders(spark, d):
    """Every column, from one pass over the table."""
    return profile.columns(t(spark, d, "orders")).select("column_name", "missing", "unique_values", "min", "max", F.round("mean", 4).alias("mean"), "zeros", "negatives")


KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values FROM lineitem" for c in KEYS) + " UNION ALL SELECT 'far', count(DISTINCT l_orderkey * 1000003) FROM lineitem")
def distinct_keys(spark, d):
    """Different numbers of all key columns by bitmaps, and of one that is not dense."""
    return profile.distinct_counts(t(spark, d, "lineitem").select(*KEYS, (F.col("l_orderkey") * 1000003).alias("far")))


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, cast(min({c}) AS double) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(quantile_cont({c}, 0.95), 4) AS q95, cast(max({c}) AS double) AS max, count_if({c} IS NULL) AS missing FROM lineitem" for c in NUMBERS))
def numeric_summary_all(spark, d):
    """All numeric columns, their quantiles found together."""
    out = profile.numeric_summary(t(spark, d, "lineitem").select(*NUMBERS))
    return out.select("column_name", "count", *[F.round(c, 4).alias(c) if c not in ("min", "max") else F.col(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "q95", "max")], "missing")


# --- loading and whole runs ---------------------------------------------------------------------


@query("SELECT unique_id, coalesce(property_address, '') AS property_address, coalesce(cast(acreage AS string), '') AS acreage FROM {sales}")
def csv_bom_load(spark, d):
    """Files with a byte order mark each, in order, loaded and replaced as a table."""
    at = scratch(spark, "load")
    marked = v(spark, d, "sales").select("unique_id", "property_address", "acreage").orderBy("unique_id").withColumnRenamed("unique_id", "\ufeffunique_id")
    tables.write_csv(marked, f"{at}/marked", single=False)
    for _ in range(2):  # the second replaces the first
        tables.load_csv(spark, f"{at}/marked", f"{at}/table", fields("unique_id string, property_address string, acreage string"))
    return spark.read.parquet(f"{at}/table").select(L("unique_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("property_address", "acreage")])


@query("WITH p AS (SELECT parcel_id, arg_min(property_address, unique_id) AS a FROM {sales} WHERE property_address IS NOT NULL GROUP BY 1), o AS (SELECT parcel_id, owner_name, arg_min(owner_address, unique_id) AS b FROM {sales} WHERE owner_address IS NOT NULL AND owner_name IS NOT NULL GROUP BY 1, 2) SELECT s.unique_id, property_address IS NULL AND a IS NOT NULL AS property_address_imputed, owner_address IS NULL AND b IS NOT NULL AS owner_address_imputed FROM {sales} s LEFT JOIN p ON p.parcel_id = s.parcel_id LEFT JOIN o ON o.parcel_id = s.parcel_id AND o.owner_name = s.owner_name")
def snapshot_provenance(spark, d):
    """Filled addresses marked against the snapshot of the source, read from its file."""
    at, sales = scratch(spark, "snapshot"), whole_sales(spark, d)
    tables.write_csv(sales.select(*[F.col(c).alias(r) for c, r in zip(CLEAN_COLUMNS, RAW_COLUMNS, strict=True)]), at, single=False)
    filled = impute.fill(impute.fill(sales, ["parcel_id"], *PARTIES[0]), ["parcel_id", "owner_name"], *PARTIES[1]).withColumns({flag: F.lit(False) for _, flag in PARTIES})
    return impute.mark_provenance(filled, tables.read_snapshot(spark, at), PARTIES).select("unique_id", "property_address_imputed", "owner_address_imputed")


# --- whole sequence -----------------------------------------------------------------------------

ONE_BLANK = "regexp_replace({0}, ' {{2,}}', ' ', 'g')"
MONEY, DAY = "cast(nullif(regexp_extract(replace({0}, ',', ''), '\\d+(?:\\.\\d+)?'), '') AS double)", "cast(cast({0} AS date) AS string)"
RAW_SQL = fixtures.RAW.replace("`", '"')
NAMED = "SELECT cast(\"UniqueID\" AS bigint) AS unique_id, \"ParcelID\" AS parcel_id, \"LandUse\" AS land_use, " + ONE_BLANK.format('"PropertyAddress"') + " AS p0, " + DAY.format('"SaleDate"') + " AS sale_date, " + MONEY.format('"SalePrice"') + " AS sale_price, \"LegalReference\" AS legal_reference, \"SoldAsVacant\" IN ('Yes', 'Y') AS sold_as_vacant, " + ONE_BLANK.format('"OwnerName"') + " AS owner_name, " + ONE_BLANK.format('"OwnerAddress"') + ' AS o0, cast("Acreage" AS double) AS acreage, "TaxDistrict" AS tax_district, cast("LandValue" AS double) AS land_value, cast("BuildingValue" AS double) AS building_value, cast("TotalValue" AS double) AS total_value, cast("YearBuilt" AS double) AS year_built, cast("Bedrooms" AS double) AS bedrooms, cast("FullBath" AS double) AS full_bath, cast("HalfBath" AS double) AS half_bath FROM raw'
CLEANED = (
    f"WITH raw AS ({RAW_SQL}), named AS ({NAMED}), dp AS (SELECT parcel_id, arg_min(p0, unique_id) AS dp FROM named WHERE p0 IS NOT NULL GROUP BY 1), do_ AS (SELECT parcel_id, owner_name, arg_min(o0, unique_id) AS d_o FROM named WHERE o0 IS NOT NULL AND owner_name IS NOT NULL GROUP BY 1, 2), "
    "filled AS (SELECT n.*, coalesce(p0, dp) AS p1, p0 IS NULL AND dp IS NOT NULL AS property_address_imputed, coalesce(o0, d_o) AS o1, o0 IS NULL AND d_o IS NOT NULL AS owner_address_imputed FROM named n LEFT JOIN dp ON n.parcel_id = dp.parcel_id LEFT JOIN do_ ON n.parcel_id = do_.parcel_id AND n.owner_name = do_.owner_name), "
    f"forms AS (SELECT unique_id, parcel_id, p1, length(p1) - length(replace(p1, ' ', '')) AS sp, {BARE.format('p1')} AS bare, trim({SQUEEZE.format('p1')}) AS form FROM filled WHERE p1 IS NOT NULL), "
    "spaced AS (SELECT a.unique_id, arg_min(b.p1, (-b.sp, b.unique_id)) AS s FROM forms a JOIN forms b ON a.parcel_id = b.parcel_id AND a.form = b.form AND a.unique_id <> b.unique_id WHERE a.sp < b.sp AND levenshtein(a.bare, b.bare) > 0 AND levenshtein(a.bare, b.bare) / greatest(length(a.p1), length(b.p1)) < 0.5 GROUP BY 1), "
    "letters AS (SELECT f.*, regexp_replace(coalesce(s, p1), '(\\d+ [ABC])(\\w) ', '\\1 \\2 ', 'g') AS p2 FROM filled f LEFT JOIN spaced USING (unique_id)), "
    "creek AS (SELECT *, regexp_replace(CASE WHEN p2 LIKE '%FALL CREEK DR%' AND o1 IS NOT NULL THEN regexp_replace(o1, ',\\s*TN\\s*$', '') ELSE p2 END, '(\\d+ [BC])([BC]\\w+)', '\\1 \\2', 'g') AS p3 FROM letters), "
    f"streets AS (SELECT *, {GROUP.format('p3')} AS ga, {GROUP.format('o1')} AS gb FROM creek), "
    "alike AS (SELECT *, coalesce(length(ga) <> length(gb) AND levenshtein(ga, gb) / nullif(greatest(length(ga), length(gb)), 0) < 0.5 AND levenshtein(ga, gb) > 0 AND replace(ga, ' ', '') = replace(gb, ' ', ''), false) AS alike FROM streets), "
    "agreed AS (SELECT *, CASE WHEN alike AND length(ga) < length(gb) THEN o1 ELSE p3 END AS property_address, CASE WHEN alike AND length(ga) > length(gb) THEN p3 ELSE o1 END AS owner_address FROM alike), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY parcel_id, property_address, sale_price, sale_date, legal_reference ORDER BY unique_id) AS rn FROM agreed) "
    "SELECT unique_id, parcel_id, land_use, property_address, sale_date, sale_price, legal_reference, sold_as_vacant, owner_name, owner_address, acreage, tax_district, land_value, building_value, total_value, year_built, bedrooms, full_bath, half_bath, 'USD' AS currency_code, property_address_imputed, owner_address_imputed FROM ranked WHERE rn = 1"
)


@query(CLEANED)
def cleaning_pipeline(spark, d):
    """Raw text rows through the whole cleaning sequence."""
    return clean(fixtures.read(spark, d, fixtures.RAW)).withColumns({"sale_date": F.col("sale_date").cast("string"), "sale_price": F.col("sale_price").cast("double")})


STREET = "nullif(upper(trim(split_part({0}, ',', 1))), '')"


@query(f"WITH c AS ({CLEANED}), a AS (SELECT {STREET.format('property_address')} AS a FROM c UNION ALL SELECT {STREET.format('owner_address')} FROM c) SELECT 'raw' AS name, count(*) AS rows FROM {{sales}} UNION ALL SELECT 'sales', count(*) FROM c UNION ALL SELECT 'addresses', count(DISTINCT a) FROM a UNION ALL SELECT 'mappings', count(a) FROM a")
def prepared_store(spark, d):
    """A raw file through the whole run; the tables that it publishes, the raw one kept."""
    at = scratch(spark, "prepared")
    tables.write_csv(fixtures.read(spark, d, fixtures.RAW), f"{at}/raw.csv", single=False)
    prepare.prepare(spark, f"{at}/raw.csv", f"{at}/store", keep_tables=True)
    store = prepare.Store(spark, f"{at}/store")
    counts = [store.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("raw", "sales", "addresses", "mappings")]
    return functools.reduce(DataFrame.unionByName, counts)

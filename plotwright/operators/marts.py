"""What reports read: the export's rows, the geocoding status, the map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotwright.functions.spatial import tile
from plotwright.functions.text import bathrooms, confidence_label, or_na, percent_label
from plotwright.functions.values import bucket, nice_round
from plotwright.operators.profile import quantiles
from plotwright.operators.selection import quantiles_by_group
from plotwright.schemas import EXPORT_COLUMNS, POINT_COLUMNS
from plotwright.storage import settle

MAP_ROWS = 60_000


def export_rows(sales: DataFrame, mappings: DataFrame, cache: DataFrame, columns: Sequence[str] = EXPORT_COLUMNS) -> DataFrame:
    """Sales with the places of their property and owner. Each role's mappings meet the cache once, then the sales."""
    out = sales.select(*columns)
    for role in ("property", "owner"):
        placed = mappings.where(F.col("address_type") == role).join(cache.select("address_id", *POINT_COLUMNS), "address_id").select(F.col("housing_id").alias(f"{role}_housing_id"), *[F.col(c).alias(f"{role}_{c}") for c in POINT_COLUMNS])
        out = out.join(placed, out["unique_id"] == placed[f"{role}_housing_id"], "left").drop(f"{role}_housing_id")
    return out


def status(cache: DataFrame) -> DataFrame:
    """One row: counts by state and provider, and the share geocoded to two places."""
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return cache.agg(F.count("*").alias("total_addresses"), F.count_if(placed).alias("geocoded_count"), F.count_if(~placed).alias("not_geocoded_count"), F.count_if(F.col("geocode_source") == "OSM").alias("osm_count"), F.count_if(F.col("geocode_source") == "HERE").alias("here_count"), (F.count_if(placed).cast("decimal(20,0)") / F.nullif(F.count("*"), F.lit(0)).cast("decimal(20,0)") * 100).cast("decimal(5,2)").alias("geocoded_percentage"))


def dashboard(cache: DataFrame) -> DataFrame:
    """One row: counts by status, mean confidence, and their labels."""
    s = F.col("geocode_status")
    counted = cache.agg(F.count("*").alias("total"), F.count_if(s == "GEOCODED").alias("geocoded"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "MANUALLY_CORRECTED").alias("corrected"), F.count_if(s.isNull()).alias("pending"), F.avg("geocode_confidence").alias("mean_confidence"))
    return counted.select("*", *[percent_label(F.col(c), F.col("total")).alias(f"{c}_label") for c in ("geocoded", "failed", "corrected", "pending")], confidence_label(F.col("mean_confidence")).alias("confidence_label"))


def by_source(cache: DataFrame) -> DataFrame:
    return cache.groupBy("geocode_source", "geocode_status").agg(F.count("*").alias("n")).orderBy("geocode_source", "geocode_status")


def map_rows(sales: DataFrame, mappings: DataFrame, cache: DataFrame, limit: int = MAP_ROWS) -> DataFrame:
    """Priced sales with the place of their property, one row each: dearest first (unknown before all), then least address id."""
    placed = cache.where("latitude is not null and longitude is not null").select("address_id", "address_standardized", "latitude", "longitude")
    joined = sales.where("sale_price is not null").join(mappings.where("address_type = 'property'").select(F.col("housing_id").alias("unique_id"), "address_id"), "unique_id").join(placed, "address_id")
    w = Window.partitionBy("unique_id").orderBy(F.col("sale_price").desc_nulls_first(), "address_id")
    return joined.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_").orderBy("unique_id").limit(limit)


def price_breaks(df: DataFrame, price: str = "sale_price") -> DataFrame:
    """One row, one array: quartiles rounded to two digits, or exact where rounding would merge them; in order."""
    q = F.array(*[F.lit(x).cast("double") for x in quantiles(df, price, (0.25, 0.5, 0.75))])
    exact = df.sparkSession.range(1).select(q.alias("q"))
    rounded = F.transform("q", nice_round)
    return exact.select(F.sort_array(F.when(F.size(F.array_distinct(rounded)) < 3, F.col("q")).otherwise(rounded)).alias("breaks"))


def bucketed(df: DataFrame, price: str = "sale_price") -> DataFrame:
    return df.crossJoin(F.broadcast(price_breaks(df, price))).withColumn("price_bucket", bucket(F.col(price), F.col("breaks"))).drop("breaks")


def map_summary(df: DataFrame) -> DataFrame:
    """One row: centre, price range and mean, and count."""
    return df.agg(F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lng"), F.min("sale_price").alias("price_min"), F.max("sale_price").alias("price_max"), F.avg("sale_price").alias("price_avg"), F.count("*").alias("n"))


def clusters(df: DataFrame, breaks: Column, digits: int = 2) -> DataFrame:
    """One row per cell of rounded coordinates: markers, median price and its bucket."""
    cells = df.groupBy(F.round("latitude", digits).alias("cell_lat"), F.round("longitude", digits).alias("cell_lng")).agg(F.count("*").alias("n"), F.median("sale_price").alias("median_price"))
    return cells.withColumn("price_bucket", bucket(F.col("median_price"), breaks))


def pyramid(df: DataFrame, zooms: Sequence[int], breaks: Column, value: str = "sale_price", latitude: str = "latitude", longitude: str = "longitude", most: int = 1_000_000) -> DataFrame:
    """(zoom, tile, n, median_price, price_bucket): markers per tile of a quadtree, for all ``zooms`` from one pass over the rows; tiles are numbered along the space-filling curve.

    Rows are first counted by finest tile and value; the counts of a tile are its children's together, so medians are exact at
    every zoom. Tiles of up to ``most`` different values are one group each; those of more are found by histograms, all at once.
    Rows without a place or a value are left out.
    """
    top = max(zooms)
    code = tile(F.col(latitude), F.col(longitude), top)
    fine = settle(df.where(code.isNotNull() & F.col(value).isNotNull()).groupBy(code.alias("code"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n")))
    up = F.explode(F.array(*[F.struct(F.lit(z).alias("zoom"), F.shiftright("code", 2 * (top - z)).alias("tile")) for z in zooms]))
    counts = fine.select(up.alias("t"), "x", "n").select("t.*", "x", "n").groupBy("zoom", "tile", "x").agg(F.sum("n").alias("n"))
    # Few values in all leave no tile with too many.
    large = settle(counts).groupBy("zoom", "tile").agg(F.count("*").alias("d"), F.sum("n").alias("n")).where(F.col("d") > most).collect() if fine.count() > most else []
    small, found = counts, None
    if large:
        spark = df.sparkSession
        ids = F.broadcast(spark.createDataFrame([(r["zoom"], r["tile"], k) for k, r in enumerate(large)], "zoom int, tile long, g int"))
        small = counts.join(ids, ["zoom", "tile"], "left_anti")
        medians = quantiles_by_group(counts.join(ids, ["zoom", "tile"]).select("g", "x", "n"), (0.5,))
        found = spark.createDataFrame([(r["zoom"], r["tile"], r["n"], medians[k][0]) for k, r in enumerate(large)], "zoom int, tile long, n long, median_price double")
    each = small.groupBy("zoom", "tile").agg(F.sum("n").alias("n"), F.percentile("x", F.lit(0.5), F.col("n")).alias("median_price"))
    every = each if found is None else each.unionByName(found)
    return every.withColumn("price_bucket", bucket(F.col("median_price"), breaks))


def publish_bucketed(sales: DataFrame, mappings: DataFrame, cache: DataFrame, name: str, folder: str, buckets: int = 64) -> None:
    """Catalogue tables ``name``_sales, and ``name``_property and ``name``_owner: the address dimension in each of its roles, with the key of the sale it belongs to. All are bucketed and sorted by that key, one file a bucket, below ``folder``."""

    def put(df: DataFrame, key: str, table: str) -> None:
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{table}").mode("overwrite").saveAsTable(f"{name}_{table}")

    put(sales, "unique_id", "sales")
    for role in ("property", "owner"):
        placed = mappings.where(F.col("address_type") == role).join(cache.select("address_id", *POINT_COLUMNS), "address_id")
        put(placed.select(F.col("housing_id").alias("unique_id"), *[F.col(c).alias(f"{role}_{c}") for c in POINT_COLUMNS]), "unique_id", role)


def export_bucketed(spark: SparkSession, name: str, columns: Sequence[str] = EXPORT_COLUMNS) -> DataFrame:
    """The export's rows from bucketed tables: buckets meet where they lie, nothing is shuffled."""
    out = spark.table(f"{name}_sales").select(*columns)
    for role in ("property", "owner"):
        out = out.join(spark.table(f"{name}_{role}").hint("merge"), "unique_id", "left")
    return out


def popups(df: DataFrame) -> DataFrame:
    """The texts that a marker shows."""
    rooms = bathrooms(F.col("full_bath"), F.col("half_bath"))
    money = lambda c: F.concat(F.lit("$"), F.format_number(F.col(c).cast("double"), 0))
    return df.select(
        "unique_id",
        F.coalesce("address_standardized", "property_address").alias("display_address"),
        money("sale_price").alias("price"),
        F.coalesce(F.date_format("sale_date", "MMM dd, yyyy"), F.lit("Unknown")).alias("sold"),
        or_na(F.col("bedrooms"), F.col("bedrooms").cast("int").cast("string")).alias("bedrooms"),
        F.when(rooms > 0, rooms.cast("string")).otherwise("N/A").alias("bathrooms"),
        or_na(F.col("year_built"), F.col("year_built").cast("int").cast("string")).alias("year_built"),
        or_na(F.col("acreage"), F.format_string("%.2f", F.col("acreage"))).alias("acreage"),
        or_na(F.col("total_value"), money("total_value")).alias("total_value"),
    )

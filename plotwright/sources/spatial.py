"""Tables laid out along a space-filling curve, so that a box of coordinates reads few files."""

from __future__ import annotations

import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.functions.spatial import cover, tile
from plotwright.functions.values import LATITUDES, LONGITUDES
from plotwright.storage import file_system, swap

#: The column of tile numbers, and rows of a file.
CODE, ROWS = "tile_", 1_000_000


def publish(df: DataFrame, path: str, latitude: str = "latitude", longitude: str = "longitude", files: int | None = None, rows_per_file: int = ROWS) -> None:
    """``path/rows``, sorted by tile over files of equal size, and ``path/files``, the tiles of each file. Rows without a place are kept, and in no box."""
    spark = df.sparkSession
    fs, make = file_system(spark, path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    coded = df.withColumn(CODE, tile(F.col(latitude), F.col(longitude)))
    files = files or max(1, -(-coded.count() // rows_per_file))
    # The last key parts places that very many rows share.
    keyed = coded.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(files, CODE, longitude, latitude, "tie_").sortWithinPartitions(CODE, longitude, latitude).drop("tie_")
    try:
        keyed.write.parquet(f"{staged}/rows")
        name = F.col("_metadata.file_name")
        spark.read.parquet(f"{staged}/rows").groupBy(name.alias("file")).agg(F.min(CODE).alias("low"), F.max(CODE).alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{staged}/files")
        swap(spark, staged, path)
    finally:
        fs.delete(make(staged), True)


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def in_box(spark: SparkSession, path: str, latitudes: tuple[float, float] = LATITUDES, longitudes: tuple[float, float] = LONGITUDES, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """The rows of a published table whose place lies in the box, edges included. Files without a tile of the box are not opened; in the others the ranges of tiles go down to the reader, which skips row groups by them."""
    ranges = cover(latitudes, longitudes)
    found = spark.read.parquet(f"{path}/files").where(any_of([(F.col("low") <= b) & (F.col("high") >= a) for a, b in ranges])).select("file").collect()
    if not found:
        return spark.read.parquet(f"{path}/rows").where(F.lit(False)).drop(CODE)
    rows = spark.read.parquet(*[f"{path}/rows/{r['file']}" for r in found])
    exact = F.col(latitude).between(*latitudes) & F.col(longitude).between(*longitudes)
    return rows.where(any_of([F.col(CODE).between(a, b) for a, b in ranges])).where(exact).drop(CODE)

"""Reading and writing of files and catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright import schemas, storage
from plotwright.functions.text import csv_value
from plotwright.session import DatabaseConfig, checked_identifier

BOM = b"\xef\xbb\xbf"


def strip_bom(source: str, target: str) -> bool:
    """A byte for byte copy without a leading byte order mark; returns whether there was one. For local files; Spark's reader skips the mark itself."""
    import shutil

    with open(source, "rb") as i, open(target, "wb") as o:
        start = i.read(len(BOM))
        if start != BOM:
            o.write(start)
        shutil.copyfileobj(i, o)
        return start == BOM


#: A line at whose end a quoted field is still open. Quotes within an unquoted field are letters; after a closing quote the field runs on to its comma.
OPEN = r'^(?>(?>"(?>[^"]++|"")*+"[^,]*+|[^",][^,]*+)?,)*+"(?>[^"]++|"")*+\z'


def splits(spark: SparkSession, path: str) -> bool:
    """Whether the file at ``path`` (or those of the folder) are large and every line is a row: then they can be read in pieces, with the same rows."""
    fs, make = storage.file_system(spark, path)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    found = fs.globStatus(make(path)) or []
    if max((f.getLen() for one in found for f in (fs.listStatus(one.getPath()) if one.isDirectory() else [one])), default=0) <= most:
        return False
    lines, line = spark.read.text(path, lineSep="\n"), F.regexp_replace("value", "\r\\z", "")
    odd = (line.contains('"') & line.rlike(OPEN)) | line.contains("\r") | ((line != "") & (F.trim(line) == ""))
    return not lines.where(odd).limit(1).count()


def read_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW, multi_line: bool = True) -> DataFrame:
    """Headed UTF-8 CSV by an explicit schema; quotes double inside quotes, '' is null. Fields may span lines, and a file with such is read by one task; large files without any, which one pass over their lines tells, are split, as all are without ``multi_line``."""
    multi_line = multi_line and not splits(spark, path)
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=multi_line, enforceSchema=False, encoding="UTF-8")


def load_csv(spark: SparkSession, path: str, target: str, schema: T.StructType = schemas.RAW) -> int:
    """Replaces the Parquet table at ``target`` by the file's rows; returns their number."""
    storage.publish(read_csv(spark, path, schema), target)
    return spark.read.parquet(target).count()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The source snapshot: an integer key and text columns, headers as in the raw file."""
    raw = read_csv(spark, path)
    return raw.select(*[F.col(r).cast(f.dataType).alias(f.name) for r, f in zip(schemas.RAW_COLUMNS, schemas.SNAPSHOT, strict=True)])


def read_jdbc(spark: SparkSession, config: DatabaseConfig, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32) -> DataFrame:
    """A database table; by ranges of ``key`` in parallel where its bounds are given. Needs a JDBC driver on the class path."""
    reader = spark.read.format("jdbc").option("url", config.url()).option("dbtable", checked_identifier(table))
    if key and bounds:
        reader = reader.options(partitionColumn=checked_identifier(key), lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def probe(df: DataFrame) -> DataFrame:
    """One row at most: shows that the source can be read."""
    return df.limit(1)


def columns_of(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type, is_nullable), in order."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string, is_nullable boolean")


def ensure_database(spark: SparkSession, name: str) -> bool:
    """Creates the database if missing; returns whether it did."""
    if spark.catalog.databaseExists(checked_identifier(name)):
        return False
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    return True


def missing_tables(spark: SparkSession, names: Sequence[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]


def add_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, as nulls; those it has stay."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in have})


def rendered(df: DataFrame) -> DataFrame:
    """All cells as the text of a CSV cell."""
    return df.select(*[csv_value(F.col(c), t).alias(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """Headed CSV with CRLF line ends. ``single``: one file, in the order of ``df``; else one per partition."""
    text = rendered(df)
    (text.coalesce(1) if single else text).write.csv(path, header=True, lineSep="\r\n", emptyValue="", nullValue="", quote='"', escape='"')


def redacted(df: DataFrame, hidden: Sequence[str] = schemas.OWNER_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden})

"""Hourly series: parquet scans with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmwatt import schemas
from firmwatt.operators.cleaning import clean_solar, clean_wind


def read_series(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Raw series from one or more parquet paths. The input is left in place."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(schema).parquet(*paths)


def read_wind_series(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return clean_wind(read_series(spark, path, schemas.RAW_WIND))


def read_solar_series(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return clean_solar(read_series(spark, path, schemas.RAW_SOLAR))


def read_tower_series(spark: SparkSession, path: str | list[str], files: DataFrame) -> DataFrame:
    """Cleaned series of many towers in one scan.

    ``files`` maps ``file_path``, the whole path, to ``tower_id`` (and ``plant_id``): files
    of two folders may share a name. One multi-path read and one join replace a read per tower.
    """
    raw = read_series(spark, path, schemas.RAW_WIND).withColumn(
        "file_path", F.col("_metadata.file_path")
    )
    return tag_towers(raw, files, "file_path")


def tag_towers(raw: DataFrame, files: DataFrame, key: str, columns: list[Column | str] | None = None) -> DataFrame:
    """Cleaned rows of every tower whose file or series a raw row belongs to.

    A row is cleaned once, whatever the number of its towers, and ``columns``, if given, are
    taken of the cleaned row. Few series drive many towers, so the rows are dealt evenly, a series
    over several tasks, before they fan out; ``files`` should be stored, so that its size is known.
    """
    cleaned = clean_wind(raw)
    kept = [c for c in raw.columns if c in cleaned.columns]
    readings = [c for c in cleaned.columns if c not in kept]
    if columns is not None:
        kept, readings = [key], cleaned.select(*columns).columns
        cleaned = cleaned.select(key, *columns)
    order = [c for c in kept if c != key] + [c for c in files.columns if c != key] + readings
    return dealt(cleaned, key).join(files, key).select(*order)


def dealt(rows: DataFrame, key: str | None = None) -> DataFrame:
    """The rows over all tasks evenly: few of them fan out to many, and none by its series.

    With a ``key``, each task gets a stretch of the rows ordered by it, whole or cut. What rows
    of one key fan out to is the same list then, again and again, which files store in little space.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if key is None:
        return rows.repartition(parts)
    numbered = rows.withColumn("row_number", F.monotonically_increasing_id())
    return numbered.repartitionByRange(parts, key, "row_number").drop("row_number")

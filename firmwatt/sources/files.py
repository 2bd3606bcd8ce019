"""The files of the series as tables: which lie in a folder, which requests name, which can be read.

A request names a file by its path below the folder of all series. The path ends with its
first ``.parquet``, so a series may also be a folder of parts, as Spark writes them.

A job reads the whole folder in one scan and joins it with the names, whatever their number.
A file that is missing or cannot be read fails the plants that name it and no others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmwatt.operators import quality
from firmwatt.sources.sinks import stage


def series_file(spark: SparkSession, folder: str) -> Column:
    """The name of a row's file: its path below ``folder`` up to its first ``.parquet``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    below = len(files.makeQualified(path).toUri().getPath().rstrip("/")) + 2
    full = F.parse_url(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), F.lit("PATH"))
    return F.regexp_extract(F.substring(F.url_decode(full), below, 1 << 30), r"^(.*?\.parquet)(?:/|$)", 1)


def scan_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that can be read below ``folder``, with their ``series_file``."""
    rows = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .parquet(folder)
    )
    return rows.withColumn("series_file", series_file(spark, folder)).filter("series_file != ''")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``series_file``, ``parts`` and ``bytes`` of what lies below ``folder``; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return (
        listed.select(series_file(spark, folder).alias("series_file"), "length")
        .filter("series_file != ''")
        .groupBy("series_file")
        .agg(F.count("*").alias("parts"), F.sum("length").alias("bytes"))
    )


def readable_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The inventory with ``n_rows`` and ``readable``.

    A part that can't be read is left out by the scan, or cut short. So the parts and rows that
    the footers promise (a scan without columns) are compared with those of a scan of all columns.
    """
    part = F.col("_metadata.file_path")
    rows = scan_folder(spark, folder, schema).withColumn("part", part)
    promised = rows.groupBy("series_file", "part").agg(F.count("*").alias("n")).groupBy("series_file").agg(
        F.count("*").alias("footers"), F.sum("n").alias("promised")
    )
    columns = [c for c in rows.columns if c not in ("series_file", "part")]
    # any value of any column: all of them have to be decoded
    decoded = F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) >= 0)
    read = rows.groupBy("series_file").agg(decoded.alias("n_rows"))
    sound = (F.col("footers") == F.col("parts")) & (F.col("promised") == F.coalesce("n_rows", F.lit(0)))
    return (
        inventory(spark, folder)
        .join(promised, "series_file", "left")
        .join(read, "series_file", "left")
        .select("series_file", "parts", "bytes", "n_rows", F.coalesce(sound, F.lit(False)).alias("readable"))
    )


@dataclass
class SeriesFiles:
    """The named series that can be read, and what became of each name.

    series    series_id (the file's name) and the cleaned columns
    files     plant_id, series_file, n_rows, problem (NULL, 'missing' or 'unreadable')
    """

    series: DataFrame
    files: DataFrame

    def status(self) -> DataFrame:
        """Rows of the plant status."""
        return quality.violations_of(
            self.files,
            ("files", "series file is missing", F.col("problem") == "missing"),
            ("files", "series file cannot be read", F.col("problem") == "unreadable"),
        )


def named_series(
    spark: SparkSession, folder: str, names: DataFrame, schema: str, clean: Callable[[DataFrame], DataFrame]
) -> SeriesFiles:
    """The series of ``names`` (plant_id, series_file) below ``folder``.

    A name that is NULL is missing, so is a file of no bytes, which Spark does not list; names given twice by a plant count once; files that nobody
    names are not read on.
    """
    known = readable_files(spark, folder, schema)
    problem = F.when(F.col("readable").isNull(), "missing").when(~F.col("readable"), "unreadable")
    files = names.select("plant_id", "series_file").distinct().join(known, "series_file", "left")
    files = stage(files.select("plant_id", "series_file", "n_rows", problem.alias("problem")))
    wanted = files.filter("problem IS NULL").select("series_file").distinct()
    rows = scan_folder(spark, folder, schema).join(wanted, "series_file")
    return SeriesFiles(clean(rows.withColumnRenamed("series_file", "series_id")), files)

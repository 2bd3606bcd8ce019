"""Result tables, CSV and the result document of each plant."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a session on
    one machine uses a temporary folder, set once; a session on a cluster fails, as its
    executors would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="firmwatt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Stages:
    """The folders of the stages that are stored while it is entered, to be removed together.

    Rows of a stage are read lazily, so ``release`` comes after the results that
    need them are written.
    """

    _open: ContextVar[tuple[Stages, ...]] = ContextVar("stages", default=())

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> Stages:
        self._token = self._open.set((*self._open.get(), self))
        return self

    def __exit__(self, *error: object) -> None:
        self._open.reset(self._token)

    @classmethod
    def note(cls, folder: str) -> None:
        for run in cls._open.get()[-1:]:
            run.folders.append(folder)

    def release(self) -> None:
        """Delete the folders, through the file system that they are on."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[Stages]:
    """Stages stored inside are gone afterwards, also after an error; write results before."""
    with Stages(spark) as run:
        try:
            yield run
        finally:
            run.release()


#: Spark deletes a query's shuffle files at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    A stage boundary: what follows neither repeats the work before it nor depends
    on executors that may be lost. ``Stages`` gives the table an end. What was shuffled for
    it is deleted when it is written.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    Stages.note(path)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


#: Parts of a stored result table. A table keeps its number for life.
PLANT_BUCKETS = 128


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write one result table, replacing only the plants it holds, and read it back from storage.

    The table is cut by a hash of the plant into a fixed number of parts, so its files do not
    grow with the number of plants. The parts that hold a plant of ``df`` are written anew with
    the other plants they held before; all other parts are neither read nor written. One run at
    a time may write a table.

    Rows are dealt by part; shares are then split and joined by their size, so a plant
    with very many rows is written by several tasks.
    """
    spark, bucket = df.sparkSession, F.pmod(F.xxhash64("plant_id"), F.lit(PLANT_BUCKETS)).cast("int")
    schema = StructType([*df.schema.fields, StructField("plant_bucket", IntegerType())])
    held = spark.read.schema(schema) if _exists(spark, path) else None
    with temporary_stages(spark):
        rows = df.withColumn("plant_bucket", bucket)
        if held is not None:
            rows = stage(rows)
            touched = [r[0] for r in rows.select("plant_bucket").distinct().collect()]
            plants = rows.select(F.col("plant_id").alias("_plant")).distinct()
            before = held.parquet(path).filter(F.col("plant_bucket").isin(touched))
            rows = rows.unionByName(before.join(plants, F.col("plant_id").eqNullSafe(F.col("_plant")), "left_anti"))
        (
            rows.hint("rebalance", "plant_bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("plant_bucket")
            .parquet(path)
        )
    return spark.read.schema(schema).parquet(path).select(*df.columns)


def write_results(
    hourly: DataFrame,
    base: str,
    results: Callable[[DataFrame], dict[str, DataFrame]],
) -> dict[str, DataFrame]:
    """All five result tables.

    The hourly energy of this run, the costly part, is stored first; all tables are
    derived from that copy, so losing executors never repeats the physics. The
    plants of earlier runs stay as they are. The copy is removed when all
    tables are written; ``temporary_stages`` around a plan and this removes the plan's too.
    """
    with temporary_stages(hourly.sparkSession):
        stored = stage(hourly)
        write_table(stored, f"{base}/energy")
        return {name: write_table(df, f"{base}/{name}") for name, df in results(stored).items()}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def result_payload(firm: DataFrame, surplus: DataFrame, sent: DataFrame) -> DataFrame:
    """One JSON document per plant with its firm energy and its 12 surplus values.

    ``firm`` and ``surplus`` are the reported shapes, ``sent`` names the plant's
    ``result_file`` and ``transaction_id``. A plant has one firm row and twelve surplus
    rows, so the collected lists have a fixed size.
    """
    months = surplus.groupBy("plant_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("year").alias("Anio"),
                    F.col("month").alias("Mes"),
                    F.col("surplus_kwh_day").alias("Valor"),
                )
            )
        ).alias("eda")
    )
    row = F.struct(
        F.col("year").alias("Anio"), F.col("month").alias("Mes"), F.col("firm_kwh_day").alias("Valor")
    )
    document = F.struct(
        F.col("result_file").alias("ArchivoResultados"),
        F.array("result_file").alias("ArchivosResultados"),
        F.col("enficc").alias("DatosEnficc"),
        F.col("eda").alias("DatosEda"),
        F.col("transaction_id").alias("IdTransaccion"),
        F.lit(True).alias("CalculoCorrecto"),
    )
    return (
        firm.select("plant_id", F.array(row).alias("enficc"))
        .join(months, "plant_id")
        .join(sent, "plant_id")
        .select("plant_id", F.to_json(document).alias("payload"))
    )


def failure_payload(status: DataFrame, sent: DataFrame) -> DataFrame:
    """One JSON document per failing plant, with the messages of its failed checks.

    A plant has one status row per check, so the joined text is short.
    """
    messages = F.array_sort(F.collect_set("message"))
    failing = status.filter("n_bad > 0").groupBy("plant_id").agg(F.array_join(messages, "; ").alias("why"))
    nothing = F.array().cast("array<string>")
    document = F.struct(
        F.lit("").alias("ArchivoResultados"),
        nothing.alias("ArchivosResultados"),
        nothing.alias("DatosEnficc"),
        nothing.alias("DatosEda"),
        F.col("transaction_id").alias("IdTransaccion"),
        F.lit(False).alias("CalculoCorrecto"),
        F.col("why").alias("ExcepcionPython"),
    )
    return failing.join(sent, "plant_id").select("plant_id", F.to_json(document).alias("payload"))

"""Plant requests arriving as JSON files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmwatt import schemas
from firmwatt.sources import requests as plant_requests
from firmwatt.sources.requests import with_route

#: How the requests of each kind become dimension tables.
PARSERS = {"wind": plant_requests.wind_dimensions, "solar": plant_requests.solar_dimensions}
DEAD_LETTERS = "dead_letters"


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.REQUEST).json(folder)


def ingest_requests(
    spark: SparkSession,
    folder: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
) -> None:
    """Route every request that has arrived since the last run, then stop.

    ``handle(requests, batch_id)`` gets each micro-batch with a ``route`` column; the
    checkpoint makes sure that no file is taken twice.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        handle(with_route(batch), batch_id)

    query = (
        request_stream(spark, folder)
        .writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_to(base: str) -> Callable[[DataFrame, int], None]:
    """A handler that stores each batch under its own id, so a repeated batch
    overwrites itself instead of adding rows twice."""

    def handle(routed: DataFrame, batch_id: int) -> None:
        routed.write.mode("overwrite").partitionBy("route").parquet(f"{base}/batch={batch_id}")

    return handle


def fan_out_to(base: str) -> Callable[[DataFrame, int], None]:
    """A handler that parses each batch into all dimension tables below ``base``.

    A table's rows of a batch stand under the batch's id, so a repeated batch overwrites
    itself. Requests that no plan can take become rows of ``dead_letters`` with the reason
    and reach no other table.
    """

    def handle(routed: DataFrame, batch_id: int) -> None:
        judged = plant_requests.with_problem(routed).persist()
        try:
            tables = {DEAD_LETTERS: judged.filter("problem IS NOT NULL").withColumnRenamed("problem", "message")}
            for kind, parse in PARSERS.items():
                good = judged.filter((F.col("route") == kind) & F.col("problem").isNull())
                tables |= {f"{kind}_{name}": df for name, df in parse(good).items()}
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")
        finally:
            judged.unpersist()

    return handle


def dimensions_of(spark: SparkSession, base: str, kind: str) -> dict[str, DataFrame]:
    """The dimension tables of one kind that the handler stored, for ``from_dimensions`` of the
    kind's plan. A plant that came in several batches counts as its last one describes it."""
    empty = PARSERS[kind](spark.createDataFrame([], schemas.REQUEST))
    read = {
        name: spark.read.schema(df.schema.add("batch", "long")).parquet(f"{base}/{kind}_{name}")
        for name, df in empty.items()
    }
    last = read["plants"].groupBy("plant_id").agg(F.max("batch").alias("batch"))
    return {name: df.join(last, ["plant_id", "batch"], "left_semi").drop("batch") for name, df in read.items()}


def dead_letters(spark: SparkSession, base: str) -> DataFrame:
    """The requests that no plan can take, with the reason, and the batch they came in."""
    schema = f"{schemas.REQUEST}, route string, message string, batch long"
    return spark.read.schema(schema).parquet(f"{base}/{DEAD_LETTERS}")

"""Checks that put a plant into quarantine instead of failing the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.constants import PRESSURE_LIMIT
from firmwatt.functions.geo import valid_coordinates


def violations(df: DataFrame, bad: Column, task: str, message: str) -> DataFrame:
    """One row per plant with its number of rows for which ``bad`` holds."""
    return df.groupBy("plant_id").agg(
        F.lit(task).alias("task"),
        F.lit(message).alias("message"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad"),
    )


def violations_of(df: DataFrame, *checks: tuple[str, str, Column]) -> DataFrame:
    """Several checks (task, message, what is bad) of one table in one aggregation.

    One row per plant and check, as ``violations`` gives for one. A condition that is
    NULL is no violation.
    """
    counts = [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"n{i}") for i, (_, _, bad) in enumerate(checks)]
    rows = [
        F.struct(F.lit(task).alias("task"), F.lit(message).alias("message"), F.col(f"n{i}").alias("n_bad"))
        for i, (task, message, _) in enumerate(checks)
    ]
    return df.groupBy("plant_id").agg(*counts).select("plant_id", F.inline(F.array(*rows)))


def any_missing(*columns: str) -> Column:
    """One of the columns is NULL or no number."""
    return reduce(lambda a, b: a | b, [is_missing(F.col(c).cast("double")) for c in columns])


def outside(lat: str, lon: str) -> Column:
    """The place is not on the globe."""
    return ~F.coalesce(valid_coordinates(F.col(lat), F.col(lon)), F.lit(False))


def check_pressure(series: DataFrame) -> DataFrame:
    bad = F.col("pressure") >= PRESSURE_LIMIT
    return violations(series, bad, "pressure", "atmospheric pressure out of range")


def check_coordinates(places: DataFrame) -> DataFrame:
    good = F.coalesce(valid_coordinates(F.col("lat"), F.col("lon")), F.lit(False))
    return violations(places, ~good, "coordinates", "latitude or longitude out of range")


def is_missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def check_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [is_missing(F.col(c)) for c in columns])
    return violations(df, missing, "nulls", "missing value in " + ", ".join(columns))


def check_inverter_fit(fit: DataFrame) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [is_missing(F.col(c)) for c in ("c0", "c1", "c2", "c3")])
    return violations(fit, missing, "inverter_fit", "inverter curves are not valid")


def check_duplicates(series: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated time stamps of one series."""
    seen = series.groupBy("plant_id", *[k for k in keys if k != "plant_id"]).count()
    return violations(seen, F.col("count") > 1, "duplicates", "repeated time stamp")


def plant_status(*checks: DataFrame) -> DataFrame:
    """All check outputs as one table; ``n_bad = 0`` rows are passes."""
    return reduce(DataFrame.unionByName, checks)


def failing_plants(status: DataFrame) -> DataFrame:
    return status.filter("n_bad > 0").select("plant_id").distinct()


def accepted(df: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of the plants without any violation."""
    return df.join(failing_plants(status), "plant_id", "left_anti")

"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


# Long expression chains make one generated method per stage. Beyond 8000 bytes the
# JVM no longer compiles it, so such stages use per-operator code instead.
TUNING = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings that the plans are meant to run with."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", name: str = "firmwatt") -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", os.environ.get("FIRMWATT_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FIRMWATT_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )

"""From the speed behind the wakes to the power delivered to the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.functions.numeric import capped, floored
from firmwatt.operators.curves import curve_value


def within_temperature(power: Column, ta: Column, t_min: Column, t_max: Column) -> Column:
    """No power outside the operating temperatures; the bounds are allowed."""
    return F.when((ta < t_min) | (ta > t_max), F.lit(0.0)).otherwise(power)


def after_cable(power: Column, kv: Column, ohm_per_km: Column, km: Column) -> Column:
    """Power in kW behind the cable to the connection point."""
    current = power * 1000 / (kv * 1000)
    return (power * 1000 - current * current * (ohm_per_km * km)) / 1000


def after_connection(power: Column, kpc: Column, kt: Column, kin: Column) -> Column:
    """Power behind the connection; the three loss percentages add up."""
    return power * (F.lit(1.0) - kpc / 100 - kt / 100 - kin / 100)


def turbine_power(hours: DataFrame, steps: int) -> DataFrame:
    """Turbine output ``power`` in kW per hour.

    ``hours`` holds ``wake_speed, ta, rho`` and the turbine's ``curve, rho_nom, p_nom,
    t_min, t_max, path_km`` and its plant's ``kv, mean_ohm, kpc, kt, kin``; ``steps`` is
    ``lookup_steps`` of all curves.
    """
    found = curve_value(hours, "p", "wake_speed", "curve_power", steps).drop("curve")
    power = within_temperature(F.col("curve_power"), F.col("ta"), F.col("t_min"), F.col("t_max"))
    power = power * F.col("rho_nom") / F.col("rho")
    found = found.withColumn("power", power)
    found = found.withColumn(
        "power", after_cable(F.col("power"), F.col("kv"), F.col("mean_ohm"), F.col("path_km"))
    )
    power = after_connection(F.col("power"), F.col("kpc"), F.col("kt"), F.col("kin"))
    return found.withColumn("power", floored(capped(power, F.col("p_nom"))))

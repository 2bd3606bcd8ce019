"""Properties of moist air."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vapour_pressure(temp_c: Column) -> Column:
    return F.lit(0.0000205) * F.exp(F.lit(0.0631846) * (temp_c + 273.15))


def saturation_pressure(temp_c: Column) -> Column:
    return F.lit(611.2) * F.exp(F.lit(17.62) * temp_c / (temp_c + 243.5))


def moist_density(temp_c: Column, pressure_hpa: Column) -> Column:
    """Density in kg/m3 from temperature (deg C) and pressure (hPa)."""
    pv = vapour_pressure(temp_c)
    dry = pressure_hpa * 100 / 287.058
    wet = pv * pv / saturation_pressure(temp_c) * F.lit(1 / 287.058 - 1 / 461.5)
    return (dry - wet) / (temp_c + 273.15)

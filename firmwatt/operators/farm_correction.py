"""Large-farm (offshore) correction of the wind speed against the lead turbine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.functions.numeric import refine
from firmwatt.operators.layout import downwind_distance, upwind_position

# Upper end of the height bracket in metres and number of solver steps; the
# steps converge quadratically, eight already agree to the last digits.
HEIGHT_LIMIT = 10000.0
HEIGHT_STEPS = 12


def is_bracketed() -> Column:
    """The layer height for the row's ``x_dist`` lies below the upper bracket."""
    top = F.lit(HEIGHT_LIMIT)
    return top * (F.log(top / F.col("z02")) - 1) >= F.col("x_dist") * 0.9


def layer_height(df: DataFrame) -> DataFrame:
    """Internal boundary layer height ``ibl``: root of ``h (ln(h/z02) - 1) = 0.9 x``.

    NULL where ``x_dist`` is not positive or the root lies above the bracket.
    """
    root = refine(
        F.lit(HEIGHT_LIMIT),
        lambda h: (h + F.col("x_dist") * 0.9) / F.log(h / F.col("z02")),
        HEIGHT_STEPS,
    )
    return df.withColumn("ibl", F.when((F.col("x_dist") > 0) & is_bracketed(), root))


def profile_speed(v: Column, h: Column, z: Column, z01: Column, z02: Column) -> Column:
    """Speed behind the farm's front row from the two log profiles; unchanged above."""
    low, high = h * 0.09, h * 0.3
    near = v * F.log(h / z01) * F.log(z / z02) / (F.log(h / z02) * F.log(z / z01))
    weight = F.log(z / low) / F.lit(math.log(0.3 / 0.09))
    inner = F.log(h / z01) / F.log(h / z02) * F.log(low / z02) * (F.lit(1.0) - weight)
    outer = F.log(high / z01) * weight
    mixed = v / F.log(z / z01) * (inner + outer)
    return F.when((z > low) & (z < high), mixed).when(z < low, near).otherwise(v)


def recovered_speed(v: Column, corrected: Column, x: Column, diameter: Column) -> Column:
    """Speed after recovery, which starts 60 rotor diameters downwind."""
    share = F.pow(F.lit(0.5), (x - diameter * 60) / (diameter * 40))
    recovering = v * (F.lit(1.0) - (F.lit(1.0) - F.try_divide(corrected, v)) * share)
    return F.when(x / diameter >= 60, recovering).otherwise(corrected)


def behind_lead(hours: DataFrame, leads: DataFrame, turbines: DataFrame) -> DataFrame:
    """Turbine hours with their downwind distance ``x_dist`` to the lead turbine."""
    lead_place = turbines.select(
        "plant_id",
        F.col("turbine_id").alias("lead_id"),
        F.col("lat").alias("lead_lat"),
        F.col("lon").alias("lead_lon"),
    )
    x = downwind_distance(
        F.col("direction"), F.col("lead_lat"), F.col("lead_lon"), F.col("lat"), F.col("lon")
    )
    return (
        hours.join(leads.join(lead_place, ["plant_id", "lead_id"]), ["plant_id", "ts"])
        .filter(F.col("turbine_id") != F.col("lead_id"))
        .withColumn("x_dist", x)
        .drop("lead_lat", "lead_lon")
    )


def large_farm_correction(behind: DataFrame, mean_hubs: DataFrame) -> DataFrame:
    """Corrected speeds of the turbines behind the lead one, NULL where unchanged.

    One turbine without a solution leaves its whole farm hour uncorrected.
    """
    positive = behind.filter(F.col("x_dist") > 0).join(mean_hubs, "plant_id")
    unsolved = positive.filter(~is_bracketed()).select("plant_id", "ts").distinct()
    solved = positive.join(unsolved, ["plant_id", "ts"], "left_anti")
    return with_corrected(solved).select("plant_id", "ts", "turbine_id", "corrected")


def with_corrected(df: DataFrame) -> DataFrame:
    """Rows with ``x_dist`` and ``mean_hub`` and their corrected speed, NULL where unchanged."""
    v = F.col("wind")
    h = F.col("ibl") + F.col("mean_hub") * (2 / 3)
    z = F.col("hub") - F.col("rotor_d") / 2
    flat = profile_speed(v, F.col("h"), z, F.col("z01"), F.col("z02"))
    value = recovered_speed(v, F.col("flat"), F.col("x_dist"), F.col("rotor_d"))
    return (
        layer_height(df)
        .withColumn("h", h)
        .withColumn("flat", flat)
        .withColumn("corrected", F.nullif(value, v))
    )


def offshore_speeds(hours: DataFrame, directions: DataFrame) -> DataFrame:
    """Turbine hours with the large-farm correction applied, in one pass.

    ``hours`` also holds the turbine's offsets and its farm's ``mean_hub``; ``directions`` is
    the farm's mean direction by hour. The lead turbine and the question whether any turbine
    is unsolved are windows over one farm's turbines in one hour, which share the join's
    partitioning: nothing is joined back.
    """
    farm_hour = Window.partitionBy("plant_id", "ts")
    placed = hours.join(directions, ["plant_id", "ts"], "left").withColumn(
        "factor", upwind_position(F.col("mean_dir"), F.col("x_m"), F.col("y_m"))
    )
    place = F.struct("turbine_id", "lat", "lon")
    lead = F.max_by(place, F.struct("factor", -F.col("turbine_id"))).over(farm_hour)
    x = downwind_distance(
        F.col("direction"), F.col("lead.lat"), F.col("lead.lon"), F.col("lat"), F.col("lon")
    )
    follows = F.col("x_dist") > 0
    unsolved = F.max(F.coalesce(follows & ~is_bracketed(), F.lit(False))).over(farm_hour)
    behind = (
        placed.withColumn("lead", lead)
        .withColumn("x_dist", F.when(F.col("turbine_id") != F.col("lead.turbine_id"), x))
        .withColumn("unsolved", unsolved)
    )
    applies = follows & ~F.col("unsolved")
    return with_corrected(behind).withColumn(
        "wind", F.coalesce(F.when(applies, F.col("corrected")), "wind")
    )


def apply_corrections(hours: DataFrame, corrections: DataFrame) -> DataFrame:
    """Turbine hours with the corrected speed where there is one."""
    return (
        hours.join(corrections, ["plant_id", "ts", "turbine_id"], "left")
        .withColumn("wind", F.coalesce("corrected", "wind"))
        .drop("corrected")
    )

"""Inverter curve fit and DC to AC conversion (Sandia model, King 2007)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.constants import INVERTER_LEVELS, POINTS_PER_LEVEL
from firmwatt.functions.numeric import capped, floored

#: Inverters are numbered within their plant.
KEY = ["plant_id", "inverter_id"]


def inverter_samples(inverters: DataFrame) -> DataFrame:
    """The 21 measured points of each inverter, one row per point.

    ``p_dc_points`` and ``p_ac_points`` list the levels one after the other.
    """
    order = F.array(*[F.lit(name) for name in INVERTER_LEVELS])
    points = F.arrays_zip(F.col("p_dc_points").alias("dc"), F.col("p_ac_points").alias("ac"))
    return inverters.select(
        *KEY, "vdco", "paco", F.posexplode(points).alias("_n", "_p")
    ).select(
        *KEY, "vdco", "paco",
        F.get(order, F.floor(F.col("_n") / POINTS_PER_LEVEL).cast("int")).alias("level"),
        F.col("_p.dc").alias("dc"),
        F.col("_p.ac").alias("ac"),
    )


def level_fit(samples: DataFrame) -> DataFrame:
    """Quadratic AC(DC) per inverter and level, by sums of powers.

    Powers are scaled by the rated AC power so that the normal equations stay well
    conditioned. Adds the DC power at rated output and at zero output.
    """
    x, y = F.col("dc") / F.col("paco"), F.col("ac") / F.col("paco")
    sums = samples.groupBy(*KEY, "level", "vdco", "paco").agg(
        F.count("dc").cast("double").alias("s0"),
        F.sum(x).alias("s1"),
        F.sum(x * x).alias("s2"),
        F.sum(x * x * x).alias("s3"),
        F.sum(x * x * x * x).alias("s4"),
        F.sum(y).alias("t0"),
        F.sum(x * y).alias("t1"),
        F.sum(x * x * y).alias("t2"),
    )
    s0, s1, s2, s3, s4, t0, t1, t2 = (
        F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")
    )
    # Cramer's rule for c + b x + a x^2.
    m0, m1, m2 = s2 * s4 - s3 * s3, s1 * s4 - s2 * s3, s1 * s3 - s2 * s2
    det = s0 * m0 - s1 * m1 + s2 * m2
    det_c = t0 * m0 - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    det_b = s0 * (t1 * s4 - t2 * s3) - t0 * m1 + s2 * (s1 * t2 - s2 * t1)
    det_a = s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * m2
    fit = sums.withColumns(
        {
            "a": F.try_divide(det_a, det),
            "b": F.try_divide(det_b, det),
            "c": F.try_divide(det_c, det),
        }
    )

    def upper_root(shift: float) -> Column:
        inner = F.col("b") * F.col("b") - F.col("a") * (F.col("c") - shift) * 4
        return F.try_divide(-F.col("b") + F.sqrt(inner), F.col("a") * 2)

    paco = F.col("paco")
    return fit.select(
        *KEY,
        "level",
        "vdco",
        (F.col("a") / paco).alias("c0_level"),
        (upper_root(1.0) * paco).alias("pdco_level"),
        (upper_root(0.0) * paco).alias("pso_level"),
    )


def _level_offset() -> Column:
    """Voltage of a level minus the nominal one."""
    result = F.lit(None).cast("double")
    for name, (scale, shift) in INVERTER_LEVELS.items():
        value = F.lit(shift) + (F.lit(scale) - 1.0) * F.col("vdco")
        result = F.when(F.col("level") == name, value).otherwise(result)
    return result


def inverter_fit(samples: DataFrame) -> DataFrame:
    """``c0..c3`` per inverter: level coefficients as lines over the voltage."""
    levels = level_fit(samples).withColumn("dv", _level_offset())

    def line(value: str) -> tuple[Column, Column]:
        return F.regr_intercept(value, "dv"), F.regr_slope(value, "dv")

    at0 = {n: line(f"{n}_level") for n in ("pdco", "pso", "c0")}
    return levels.groupBy(*KEY).agg(
        at0["c0"][0].alias("c0"),
        F.try_divide(at0["pdco"][1], at0["pdco"][0]).alias("c1"),
        F.try_divide(at0["pso"][1], at0["pso"][0]).alias("c2"),
        F.try_divide(at0["c0"][1], at0["c0"][0]).alias("c3"),
        at0["pdco"][0].alias("pdco_fit"),
        at0["pso"][0].alias("pso_fit"),
    )


#: What the conversion needs of an inverter and of its fit.
NAMEPLATE = ["paco", "pdco", "vdco", "pso", "pnt", "n_inv", "c0", "c1", "c2", "c3"]


def with_nameplate(arrays: DataFrame, inverters: DataFrame, fit: DataFrame) -> DataFrame:
    """Arrays, or their hours, with the nameplate and the fit of their inverter as ``plate``.

    ``n_plates`` in it counts the rows of an inverter, as a repeated one repeats its arrays.
    """
    copies = F.count("*").over(Window.partitionBy(*KEY)).alias("n_plates")
    plates = inverters.join(fit, KEY).select(*KEY, *NAMEPLATE, copies)
    return arrays.join(plates.select(*KEY, F.struct(*NAMEPLATE, "n_plates").alias("plate")), KEY)


def inverter_ac(array_hours: DataFrame, inverters: DataFrame, fit: DataFrame) -> DataFrame:
    """AC power ``p_ac`` (W) per inverter and hour, times the inverter count."""
    return inverter_output(with_nameplate(array_hours.select(*KEY, "ts", "v_mp", "p_mp"), inverters, fit))


def inverter_output(array_hours: DataFrame) -> DataFrame:
    """AC power ``p_ac`` (W) per inverter and hour of arrays that carry their nameplate.

    Each array counts by its share of the inverter's DC power. Its output is a polynomial in
    that power, P, whose coefficients depend on the array alone:
    ``p/P (A (P - b) + c (P - b)^2) = P pc + p (A - 2bc) + p (b^2 c - A b) / P``. So sums over
    the arrays give all, in one aggregation without a sort; hours dealt by plant and stamp
    before they meet their arrays need no further shuffle for it.
    """
    col = F.col
    dv = col("v_mp") - col("vdco")
    a = col("pdco") * (F.lit(1.0) + col("c1") * dv)
    b = col("pso") * (F.lit(1.0) + col("c2") * dv)
    c = col("c0") * (F.lit(1.0) + col("c3") * dv)
    joined = array_hours.select(*KEY, "ts", "v_mp", "p_mp", "plate.*")
    joined = joined.withColumns({"_a": a, "_b": b, "_c": c})
    span = col("_a") - col("_b")
    joined = joined.withColumn("_slope", col("paco") / span - col("_c") * span)
    p, b, c = F.when(col("_slope").isNotNull(), col("p_mp")), col("_b"), col("_c")
    summed = joined.groupBy("plant_id", "inverter_id", "ts").agg(
        F.sum(col("p_mp") / col("n_plates")).alias("p_dc"),
        F.sum(p * c).alias("_square"),
        F.sum(p * (col("_slope") - b * c * 2)).alias("_linear"),
        F.sum(p * (b * c - col("_slope")) * b).alias("_fixed"),
        *[F.max(name).alias(name) for name in ("pso", "pnt", "paco", "n_inv")],
    )
    p_ac = col("p_dc") * col("_square") + col("_linear") + F.try_divide(col("_fixed"), col("p_dc"))
    limited = F.when(col("p_dc") < col("pso"), -F.abs("pnt")).otherwise(capped(p_ac, col("paco")))
    return summed.select(
        "plant_id", "inverter_id", "ts", (floored(limited) * col("n_inv")).alias("p_ac")
    )


def plant_losses(hourly: DataFrame, plants: DataFrame) -> DataFrame:
    """Connection, transformation and outage losses, then the connection limit."""
    p = plants.select(
        "plant_id",
        (
            (F.lit(1.0) - F.col("kpc") / 100)
            * (F.lit(1.0) - F.col("kt") / 100)
            * (F.lit(1.0) - F.col("kin") / 100)
            * (F.lit(1.0) - F.col("ihf") / 100)
        ).alias("_keep"),
        (F.col("ppi") / 1000).alias("_limit"),
    )
    return (
        hourly.join(p, "plant_id")
        .withColumn("kwh", capped(F.col("kwh") * F.col("_keep"), F.col("_limit")))
        .drop("_keep", "_limit")
    )

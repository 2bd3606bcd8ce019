"""Sun position, beam and diffuse irradiance, and irradiance on the modules.

All models are published ones: sun position PSA (Blanco-Muriel 2001),
extraterrestrial irradiance Spencer 1971, beam split DISC (Maxwell 1987), sky
diffuse Perez 1990, tracking Marion & Dobos 2013 / Anderson & Mikofski 2020.
Each is a chain of projections on ``(plant, ts)`` or ``(array, ts)`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.constants import GROUND_COVER_RATIO, PEREZ_BINS
from firmwatt.functions.numeric import polynomial
from firmwatt.operators.cleaning import clamp_low_sun, seconds_of_day


def sun_position(df: DataFrame) -> DataFrame:
    """``zenith, apparent_zenith, azimuth`` in degrees from ``ts_utc, lat, lon``."""
    col = F.col
    df = df.withColumn("_hour", seconds_of_day(col("ts_utc")).cast("double") / 3600)
    days = F.datediff(col("ts_utc").cast("date"), F.lit("2000-01-01").cast("date"))
    df = df.withColumn("_n", days + col("_hour") / 24 - 0.5)
    df = df.withColumns(
        {
            "_omega": F.lit(2.1429) - F.lit(0.0010394594) * col("_n"),
            "_l": F.lit(4.8950630) + F.lit(0.017202791698) * col("_n"),
            "_g": F.lit(6.2400600) + F.lit(0.0172019699) * col("_n"),
        }
    )
    df = df.withColumns(
        {
            "_lambda": col("_l")
            + F.lit(0.03341607) * F.sin("_g")
            + F.lit(0.00034894) * F.sin(col("_g") * 2)
            - 0.0001134
            - F.lit(0.0000203) * F.sin("_omega"),
            "_eps": F.lit(0.4090928)
            - F.lit(6.2140e-9) * col("_n")
            + F.lit(0.0000396) * F.cos("_omega"),
            "_phi": F.radians("lat"),
        }
    )
    sidereal = F.lit(6.6974243242) + F.lit(0.0657098283) * col("_n") + col("_hour")
    df = df.withColumns(
        {
            "_ra": F.atan2(F.cos("_eps") * F.sin("_lambda"), F.cos("_lambda")),
            "_dec": F.asin(F.sin("_eps") * F.sin("_lambda")),
        }
    )
    df = df.withColumn("_ha", F.radians(sidereal * 15 + col("lon")) - col("_ra"))
    flat = F.cos("_phi") * F.cos("_ha") * F.cos("_dec") + F.sin("_dec") * F.sin("_phi")
    df = df.withColumns(
        {
            "_z": F.acos(F.least(F.greatest(flat, F.lit(-1.0)), F.lit(1.0))),
            "_az": F.atan2(
                -F.sin("_ha"), F.tan("_dec") * F.cos("_phi") - F.sin("_phi") * F.cos("_ha")
            ),
        }
    )
    df = df.withColumns(
        {
            "zenith": F.degrees(col("_z") + F.lit(6371.01 / 149597890) * F.sin("_z")),
            "azimuth": F.pmod(F.degrees("_az"), F.lit(360.0)),
        }
    )
    up = F.lit(90.0) - col("zenith")
    bent = F.lit(1.02 / 60) / F.tan(F.radians(up + F.lit(10.3) / (up + 5.11)))
    df = df.withColumn(
        "apparent_zenith",
        F.when(up > -0.8333, col("zenith") - bent).otherwise(col("zenith")),
    )
    return df.drop(
        "_hour", "_n", "_omega", "_l", "_g", "_lambda", "_eps", "_phi", "_ra", "_dec", "_ha",
        "_z", "_az",
    )


def extraterrestrial(ts: Column, solar_constant: float = 1366.1) -> Column:
    """Irradiance outside the atmosphere by day of year."""
    b = (F.dayofyear(ts) - 1) * (2 * math.pi / 365)
    return F.lit(solar_constant) * (
        F.lit(1.00011)
        + F.cos(b) * 0.034221
        + F.sin(b) * 0.00128
        + F.cos(b * 2) * 0.000719
        + F.sin(b * 2) * 7.7e-5
    )


def beam_disc(df: DataFrame) -> DataFrame:
    """``dni, kt, airmass`` from ``ghi, zenith, ts``; airmass 0 with the sun down."""
    col = F.col
    z = col("zenith")
    cos_z = F.cos(F.radians(z))
    mass = F.lit(1.0) / (cos_z + F.lit(0.15) * F.pow(F.lit(93.885) - z, -1.253))
    clear = col("ghi") / (col("_i0") * F.greatest(cos_z, F.lit(0.065)))
    df = df.withColumn("_i0", extraterrestrial(col("ts"), 1370.0)).withColumns(
        {
            "kt": F.least(F.greatest(clear, F.lit(0.0)), F.lit(1.0)),
            "_am": F.when(z <= 90, F.least(mass, F.lit(12.0))),
        }
    )
    kt, am = col("kt"), col("_am")
    dull = kt <= 0.6

    def split(low: list[float], high: list[float]) -> Column:
        return F.when(dull, polynomial(kt, low)).otherwise(polynomial(kt, high))

    a = split([0.512, -1.56, 2.286, -2.222], [-5.743, 21.77, -27.49, 11.56])
    b = split([0.37, 0.962], [41.4, -118.5, 66.05, 31.9])
    c = split([-0.28, 0.932, -2.048], [-47.01, 184.2, -222.0, 73.81])
    limit = polynomial(am, [0.866, -0.122, 0.0121, -0.000653, 1.4e-05])
    df = df.withColumn("dni", col("_i0") * (limit - (a + b * F.exp(c * am))))
    dark = (z > 87) | (col("ghi") < 0) | (col("dni") < 0)
    return df.withColumns(
        {
            "dni": F.when(dark, F.lit(0.0)).otherwise(col("dni")),
            "airmass": F.coalesce("_am", F.lit(0.0)),
        }
    ).drop("_i0", "_am")


def diffuse_closure(df: DataFrame) -> DataFrame:
    """``dhi`` as the part of ``ghi`` the beam does not explain, then the low-sun rules."""
    dhi = F.col("ghi") - F.col("dni") * F.cos(F.radians("zenith"))
    return clamp_low_sun(df.withColumn("dhi", dhi))


def surface_orientation(df: DataFrame) -> DataFrame:
    """``tilt`` and ``surface_az`` of fixed arrays and of single-axis trackers.

    Needs ``tracker, axis_az, axis_tilt, max_angle, zenith, azimuth``; fixed arrays
    read their own azimuth and tilt from the two axis columns.
    """
    col = F.col
    z, az = F.radians("zenith"), F.radians("azimuth")
    gamma, beta = F.radians("axis_az"), F.radians("axis_tilt")
    x, y = F.sin(z) * F.sin(az), F.sin(z) * F.cos(az)
    across = x * F.cos(gamma) - y * F.sin(gamma)
    above = (x * F.sin(gamma) + y * F.cos(gamma)) * F.sin(beta) + F.cos(z) * F.cos(beta)
    df = df.withColumn("_ideal", F.atan2(across, above))
    shade = F.abs(F.cos("_ideal")) / GROUND_COVER_RATIO
    back = F.when(shade < 1, F.signum("_ideal") * F.acos(F.least(shade, F.lit(1.0)))).otherwise(
        F.lit(0.0)
    )
    limit = F.radians("max_angle")
    turned = F.greatest(F.least(col("_ideal") - back, limit), -limit)
    df = df.withColumn("_turn", turned)
    tilt = F.degrees(F.acos(F.cos("_turn") * F.cos(beta)))
    facing = col("axis_az") + F.degrees(F.atan2(F.sin("_turn"), F.cos("_turn") * F.sin(beta)))
    return df.withColumns(
        {
            "tilt": F.when(col("tracker"), tilt).otherwise(col("axis_tilt")),
            "surface_az": F.when(col("tracker"), F.pmod(facing, F.lit(360.0))).otherwise(
                col("axis_az")
            ),
        }
    ).drop("_ideal", "_turn")


def plane_irradiance(df: DataFrame) -> DataFrame:
    """Beam, sky and ground irradiance on the modules and their sum ``poa_front``.

    Needs ``tilt, surface_az, zenith, azimuth, dni, dhi, ghi, airmass, iext,
    albedo``. A clearness outside the table leaves sky and sum NULL.
    """
    col = F.col
    tilt, z = F.radians("tilt"), F.radians("zenith")
    facing = F.cos(tilt) * F.cos(z) + F.sin(tilt) * F.sin(z) * F.cos(
        F.radians(col("azimuth") - col("surface_az"))
    )
    cube = F.pow(z, 3) * 1.041
    clearness = ((col("dhi") + col("dni")) / F.nullif(col("dhi"), F.lit(0.0)) + cube) / (cube + 1)
    df = df.withColumns(
        {
            "_facing": F.greatest(facing, F.lit(0.0)),
            "_eps": clearness,
            "_delta": col("dhi") * col("airmass") / col("iext"),
        }
    )
    bin_no = sum((F.when(col("_eps") >= b[0], 1).otherwise(0) for b in PEREZ_BINS), F.lit(0))
    df = df.withColumn("_bin", bin_no)

    def coefficient(position: int) -> Column:
        values = F.array(*[F.lit(b[position]) for b in PEREZ_BINS])
        return F.when(col("_bin") > 0, F.element_at(values, F.greatest(col("_bin"), F.lit(1))))

    f1 = coefficient(1) + coefficient(2) * col("_delta") + coefficient(3) * z
    f2 = coefficient(4) + coefficient(5) * col("_delta") + coefficient(6) * z
    df = df.withColumns({"_f1": F.when(f1 < 0, F.lit(0.0)).otherwise(f1), "_f2": f2})
    bright = col("_facing") / F.greatest(F.cos(z), F.lit(math.cos(math.radians(85))))
    sky = col("dhi") * (
        (F.lit(1.0) - col("_f1")) * (F.cos(tilt) + 1) * 0.5
        + col("_f1") * bright
        + col("_f2") * F.sin(tilt)
    )
    df = df.withColumns(
        {
            "poa_beam": col("dni") * col("_facing"),
            "poa_sky": F.when(col("dhi") == 0, F.lit(0.0))
            .when(sky < 0, F.lit(0.0))
            .otherwise(sky),
            "poa_ground": col("ghi") * col("albedo") * (F.lit(1.0) - F.cos(tilt)) * 0.5,
        }
    )
    total = col("poa_beam") + col("poa_sky") + col("poa_ground")
    return df.withColumn("poa_front", total).drop(
        "_facing", "_eps", "_delta", "_bin", "_f1", "_f2"
    )


def combine_faces(df: DataFrame) -> DataFrame:
    """``poa``: the front plus, for bifacial modules, the weighted back irradiance."""
    both = F.col("poa_front") + F.col("poa_back") * F.col("bifaciality")
    return df.withColumn("poa", F.when(F.col("bifacial"), both).otherwise(F.col("poa_front")))


def irradiance_by_plant(series: DataFrame, plants: DataFrame) -> DataFrame:
    """Every irradiance column per plant and hour from ``ghi`` and the plant's place."""
    site = plants.select("plant_id", "lat", "lon", "tz")
    placed = series.join(site, "plant_id")
    utc = F.convert_timezone(F.col("tz"), F.lit("UTC"), F.col("ts"))
    df = sun_position(placed.withColumn("ts_utc", utc))
    df = df.withColumn("iext", extraterrestrial(F.col("ts")))
    return diffuse_closure(beam_disc(df)).drop("lat", "lon", "tz", "ts_utc")

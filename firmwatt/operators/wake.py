"""Wake effect between the turbines of a farm.

A wake reaches a turbine only inside a narrow cone behind its source, so pairs are
never formed for a whole farm. Per direction sector a farm is cut into square tiles along
and across the wind, about one turbine each, and every turbine lies in one of them. A
source lists the tiles that its cone touches at any direction of the sector, and an
equi-join on the tile gives the turbines it may reach. An hour of a source then finds them
in one row and keeps those in the cone turned to the hour's own direction, so the hours
are dealt once and not copied by tile. The cone's edges are straight lines, so the bounds
are exact: a pair that is left out has no overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.functions.geo import wind_angle
from firmwatt.functions.wake import overlap_share, speed_loss
from firmwatt.operators.curves import curve_value

SECTOR_DEG = 10.0
#: Slack of the cone against rounding.
SLACK_M = 0.01
#: Sine of the angle between an hour's direction and its sector's centre, at most.
TURNED = math.sin(math.radians(SECTOR_DEG / 2 + 1e-6))


def sector_of(direction: Column) -> Column:
    sector = F.floor(F.pmod(direction, F.lit(360.0)) / SECTOR_DEG).cast("int")
    return F.least(sector, F.lit(int(360 / SECTOR_DEG) - 1))


def _axes(sector: Column) -> tuple[Column, Column]:
    """East and north parts of the unit vector along the wind at the sector's centre. The one
    across is this one turned to the left."""
    angle = wind_angle((sector + 0.5) * SECTOR_DEG)
    return -F.cos(angle), -F.sin(angle)


def sector_tiles(turbines: DataFrame) -> DataFrame:
    """Place of every turbine in the tiles of its farm, one row per direction sector.

    ``turbines`` holds ``plant_id, turbine_id, x_m, y_m, dz_m, radius, cre``. The rows also have the
    side of the farm's tiles and the range of tiles that have turbines in the sector.
    """
    wide = F.max("x_m") - F.min("x_m")
    high = F.max("y_m") - F.min("y_m")
    side = F.greatest(F.sqrt(wide * high / F.count("*")), F.max("radius") * 4, F.lit(1.0))
    farms = turbines.groupBy("plant_id").agg(side.alias("side"))
    sectors = F.explode(F.sequence(F.lit(0), F.lit(int(360 / SECTOR_DEG) - 1)))
    east, north = _axes(F.col("sector"))
    placed = (
        turbines.join(farms, "plant_id")
        .select("plant_id", "turbine_id", "x_m", "y_m", "dz_m", "radius", "cre", "side", sectors.alias("sector"))
        .withColumn("along", F.col("x_m") * east + F.col("y_m") * north)
        .withColumn("across", F.col("y_m") * east - F.col("x_m") * north)
        .withColumn("tile_along", F.floor(F.col("along") / F.col("side")).cast("int"))
        .withColumn("tile_across", F.floor(F.col("across") / F.col("side")).cast("int"))
    )
    edges = placed.groupBy("plant_id", "sector").agg(
        F.max("tile_along").alias("end_along"),
        F.min("tile_across").alias("begin_across"),
        F.max("tile_across").alias("end_across"),
    )
    return placed.join(edges, ["plant_id", "sector"])


def _half_width(ahead: Column) -> Column:
    """Half the width, ``ahead`` metres along a sector's centre, of what a cone covers at any
    direction of the sector.

    At an angle of at most ``t`` to the centre a point at ``a`` along and ``c`` across lies
    ``b <= a + |c| sin t`` behind its source, and ``|c| <= 2 radius + cre b + b sin t``.
    """
    opening = F.col("cre") + TURNED
    return (F.col("radius") * 2 + SLACK_M + F.greatest(ahead, F.lit(0.0)) * opening) / (F.lit(1.0) - opening * TURNED)


def reachable(tiles: DataFrame) -> DataFrame:
    """Per source and sector the turbines that its wake may reach, as an array ``reached`` of
    their ids and offsets.

    It is as long as a twentieth of the farm or so and serves all hours of the sector.
    """
    behind = F.col("radius") * 2 + SLACK_M
    first = F.floor((F.col("along") - behind) / F.col("side")).cast("int")
    far = (F.col("tile_along") + 1) * F.col("side") - F.col("along")
    tile = lambda c: F.floor((F.col("across") + c) / F.col("side")).cast("int")
    listed = (
        tiles.select(
            "plant_id", "sector", F.col("turbine_id").alias("source_id"), "side", "end_along", "begin_across", "end_across",
            "along", "across", "radius", "cre", F.col("x_m").alias("s_x"), F.col("y_m").alias("s_y"), F.col("dz_m").alias("s_z"),
        )
        .withColumn("tile_along", F.explode(F.sequence(first, F.col("end_along"))))
        .withColumn("lowest", F.greatest(tile(-_half_width(far)), F.col("begin_across")))
        .withColumn("highest", F.least(tile(_half_width(far)), F.col("end_across")))
        .filter("lowest <= highest")
        .withColumn("tile_across", F.explode(F.sequence("lowest", "highest")))
        .drop("side", "end_along", "begin_across", "end_across", "lowest", "highest")
    )
    there = tiles.select(
        "plant_id", "sector", "tile_along", "tile_across", "turbine_id", "x_m", "y_m", "dz_m",
        F.col("along").alias("t_along"), F.col("across").alias("t_across"),
    )
    ahead, aside = F.col("t_along") - F.col("along"), F.col("t_across") - F.col("across")
    offset = F.struct(
        "turbine_id",
        (F.col("x_m") - F.col("s_x")).alias("east"),
        (F.col("y_m") - F.col("s_y")).alias("north"),
        (F.col("dz_m") - F.col("s_z")).alias("rise"),
    )
    return (
        listed.join(there, ["plant_id", "sector", "tile_along", "tile_across"])
        .filter((F.col("turbine_id") != F.col("source_id")) & (ahead >= -behind) & (F.abs(aside) <= _half_width(ahead)))
        .groupBy("plant_id", "source_id", "sector")
        .agg(F.collect_list(offset).alias("reached"))
    )


def wake_candidates(sources: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every source in an hour with the other turbines that its cone may touch.

    The rows have the offset of the affected turbine: how far it is ``behind`` the source and
    how far ``apart`` from the wake's axis.
    """
    hours = sources.select(
        "plant_id", "ts", "wind", "thrust", "radius", "cre", "direction",
        F.col("turbine_id").alias("source_id"),
        sector_of(F.col("direction")).alias("sector"),
    )
    angle = wind_angle(F.col("direction"))
    ux, uy = -F.cos(angle), -F.sin(angle)
    east, north, rise = F.col("to.east"), F.col("to.north"), F.col("to.rise")
    return (
        hours.join(reachable(tiles), ["plant_id", "source_id", "sector"])
        .withColumns({"_ux": ux, "_uy": uy})
        .withColumn("to", F.explode("reached"))
        .drop("reached")
        .withColumns(
            {"behind": east * F.col("_ux") + north * F.col("_uy"), "_side": east * F.col("_uy") - north * F.col("_ux")}
        )
        .filter((F.col("behind") > 0) & (F.abs("_side") < F.col("radius") * 2 + SLACK_M + F.col("cre") * F.col("behind")))
        .select(
            "plant_id", "ts", "source_id", F.col("to.turbine_id").alias("turbine_id"), "wind", "thrust", "radius", "cre",
            "behind", F.sqrt(F.col("_side") * F.col("_side") + rise * rise).alias("apart"),
        )
    )


def source_thrust(hours: DataFrame, steps: int) -> DataFrame:
    """Thrust coefficient of each turbine at its own speed and density.

    ``hours`` holds the turbine's ``curve``; ``steps`` is ``lookup_steps`` of all curves.
    """
    return curve_value(hours, "ct", "wind", "ct", steps).withColumn(
        "thrust", F.col("ct") * F.col("rho_nom") / F.col("rho")
    )


def wake_deficits(sources: DataFrame, tiles: DataFrame) -> DataFrame:
    """Squared speed loss that each source causes at each turbine it reaches."""
    reached = (
        wake_candidates(sources, tiles)
        .filter(F.col("behind") > 0)
        .withColumn("wake_radius", F.col("radius") + F.col("cre") * F.col("behind"))
        .filter(F.col("apart") < F.col("radius") + F.col("wake_radius"))
    )
    share = overlap_share(F.col("radius"), F.col("wake_radius"), F.col("apart"))
    loss = speed_loss(F.col("wind"), F.col("thrust"), F.col("radius"), F.col("wake_radius"))
    return reached.withColumn("loss", loss).select(
        "plant_id", "ts", "turbine_id", (share * F.col("loss") * F.col("loss")).alias("deficit")
    )


def wake_speeds(sources: DataFrame, tiles: DataFrame) -> DataFrame:
    """Speed of each turbine behind the wakes of the others, as ``wake_speed``.

    ``sources`` has one row per turbine and hour with ``wind, direction, ta, rho,
    thrust, radius, cre``. A farm hour in which any thrust exceeds 1 has no defined
    wake and keeps its speeds. Deficits and the turbines' own rows are dealt together by
    farm and hour; the sums and the check of the farm hour share that partitioning, so
    nothing is joined back.
    """
    keys, own = ["plant_id", "ts", "turbine_id"], ["wind", "ta", "rho"]
    known = F.col("plant_id").isNotNull() & F.col("ts").isNotNull()
    above = F.coalesce(known & (F.col("thrust") > 1), F.lit(False)).alias("above")
    rows = sources.select(*keys, *own, above, F.lit(0.0).alias("deficit"))
    undefined = F.max("above").over(Window.partitionBy("plant_id", "ts"))
    total = (
        rows.unionByName(wake_deficits(sources, tiles), allowMissingColumns=True)
        .repartition("plant_id", "ts")
        .groupBy(*keys)
        .agg(*[F.max(c).alias(c) for c in (*own, "above")], F.sum("deficit").alias("deficit"))
        .withColumn("deficit", F.when(undefined, F.lit(0.0)).otherwise(F.col("deficit")))
    )
    slowed = F.col("wind") - F.sqrt("deficit")
    return total.select(
        *keys, *own, F.when(slowed < 0, F.lit(0.0)).otherwise(slowed).alias("wake_speed")
    )

"""Farm geometry: towers, offsets, upwind order and cable paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.constants import EARTH_RADIUS_KM, OFFSHORE_TERRAIN, ONSHORE_TERRAIN
from firmwatt.functions import geo

# Grid levels for the tower search: level m splits the globe in 2**m columns.
FINEST_LEVEL = 15
COARSEST_LEVEL = 4


def terrain_constants(plants: DataFrame) -> DataFrame:
    """Roughness lengths ``z01, z02`` and wake expansion ``cre`` by site type."""
    columns = {
        name: F.when(F.col("offshore"), F.lit(sea)).otherwise(F.lit(land))
        for name, sea, land in zip(("z01", "z02", "cre"), OFFSHORE_TERRAIN, ONSHORE_TERRAIN)
    }
    return plants.withColumns(columns)


def _level_for(radius_km: Column) -> Column:
    """Finest level whose cells are at least as wide as the radius."""
    span = F.degrees(radius_km / EARTH_RADIUS_KM)
    fit = F.floor(F.log2(F.lit(360.0) / F.greatest(span, F.lit(1e-9))))
    return F.least(F.greatest(fit, F.lit(COARSEST_LEVEL)), F.lit(FINEST_LEVEL)).cast("int")


def tower_cells(towers: DataFrame) -> DataFrame:
    """Every grid cell that a tower's radius can reach."""
    level = _level_for(F.col("radius_km"))
    size = F.lit(360.0) / F.pow(F.lit(2.0), level)
    count = F.pow(F.lit(2.0), level).cast("bigint")
    arc = F.col("radius_km") / EARTH_RADIUS_KM * (1 + 1e-9) + 1e-12
    dlat = F.degrees(arc)
    stretch = F.sin(F.least(arc, F.lit(math.pi / 2))) / F.cos(F.radians("lat"))
    dlon = F.when(
        (stretch < 1) & (F.abs("lat") + dlat < 90), F.degrees(F.asin(F.least(stretch, F.lit(1.0))))
    ).otherwise(F.lit(180.0))
    rows = F.sequence(
        F.floor((F.col("lat") - dlat + 90) / size), F.floor((F.col("lat") + dlat + 90) / size)
    )
    first = F.floor((F.col("lon") - dlon + 180) / size)
    last = F.least(F.floor((F.col("lon") + dlon + 180) / size), first + count - 1)
    return (
        towers.withColumn("level", level)
        .withColumn("cell_y", F.explode(rows))
        .withColumn("_column", F.explode(F.sequence(first, last)))
        .withColumn("cell_x", F.pmod(F.col("_column"), count))
        .drop("_column")
    )


def nearest_tower(turbines: DataFrame, towers: DataFrame) -> DataFrame:
    """Each turbine with the tower whose series represents it.

    The declared tower stays if the turbine lies within its radius. Otherwise it
    is the closest tower that reaches the turbine, and the declared one if none
    does. Only turbines outside the declared radius enter the search, which is an
    equi-join on grid cells, so towers that cannot reach a turbine are never
    paired with it.
    """
    t = towers.select(
        "plant_id",
        "tower_id",
        F.col("lat").alias("t_lat"),
        F.col("lon").alias("t_lon"),
        F.col("elev").alias("t_elev"),
        "radius_km",
    )
    distance = geo.distance_km(
        F.col("t_lat"), F.col("t_lon"), F.col("t_elev"), F.col("lat"), F.col("lon"), F.col("elev")
    )
    declared = turbines.join(
        t.withColumnRenamed("tower_id", "declared_tower"), ["plant_id", "declared_tower"]
    ).select(
        "plant_id", "turbine_id", "lat", "lon", "elev", "declared_tower",
        (distance <= F.col("radius_km")).alias("covered"),
    )

    levels = F.sequence(F.lit(COARSEST_LEVEL), F.lit(FINEST_LEVEL))
    outside = declared.filter(~F.col("covered")).withColumn("level", F.explode(levels))
    size = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    count = F.pow(F.lit(2.0), F.col("level")).cast("bigint")
    outside = outside.withColumns(
        {
            "cell_y": F.floor((F.col("lat") + 90) / size),
            "cell_x": F.pmod(F.floor((F.col("lon") + 180) / size), count),
        }
    )
    cells = tower_cells(
        t.withColumnsRenamed({"t_lat": "lat", "t_lon": "lon"})
    ).withColumnsRenamed({"lat": "t_lat", "lon": "t_lon"})
    found = (
        outside.join(cells, ["plant_id", "level", "cell_y", "cell_x"])
        .withColumn("dist", distance)
        .filter(F.col("dist") <= F.col("radius_km"))
        .groupBy("plant_id", "turbine_id")
        .agg(F.min_by("tower_id", F.struct("dist", "tower_id")).alias("found"))
    )
    return declared.join(found, ["plant_id", "turbine_id"], "left").select(
        "plant_id",
        "turbine_id",
        "declared_tower",
        F.coalesce("found", "declared_tower").alias("tower_id"),
    )


def turbine_features(turbines: DataFrame, models: DataFrame) -> DataFrame:
    """Turbines with their model's nameplate, rotor radius and swept area."""
    radius = F.col("rotor_d") / 2
    return turbines.join(models, "model_id").withColumns(
        {"radius": radius, "area": F.lit(math.pi) * radius * radius}
    )


def fan_out_series(turbines: DataFrame, series: DataFrame) -> DataFrame:
    """Each turbine with the hourly series of its tower or plant."""
    return turbines.join(series, "series_id")


def series_matrix(hours: DataFrame, value: str) -> DataFrame:
    """One row per farm and hour: ``cells`` lists every turbine's value, by turbine id.

    A row is as wide as its farm has turbines.
    """
    cell = F.struct("turbine_id", F.col(value).alias("value"))
    return hours.groupBy("plant_id", "ts").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def matrix_to_long(matrix: DataFrame, value: str) -> DataFrame:
    """The inverse of ``series_matrix``: one row per farm, hour and turbine."""
    return matrix.select("plant_id", "ts", F.explode("cells").alias("c")).select(
        "plant_id", "ts", "c.turbine_id", F.col("c.value").alias(value)
    )


def local_offsets(turbines: DataFrame) -> DataFrame:
    """Signed metres east and north of the farm's first turbine.

    The offset between any two turbines is the difference of theirs, so the table
    has one row per turbine and never one per pair.
    """
    first = turbines.groupBy("plant_id").agg(
        F.min_by(F.struct("lat", "lon", "elev"), F.struct("ordinal", "turbine_id")).alias("_o")
    )
    return (
        turbines.join(first, "plant_id")
        .withColumns(
            {
                "x_m": geo.east_m(F.col("_o.lat"), F.col("_o.lon"), F.col("lon")),
                "y_m": geo.north_m(F.col("_o.lat"), F.col("_o.lon"), F.col("lat")),
                "dz_m": F.col("elev") - F.col("_o.elev"),
            }
        )
        .drop("_o")
    )


def mean_direction(turbines: DataFrame, series: DataFrame) -> DataFrame:
    """Arithmetic mean of the wind direction over a farm's turbines, by hour.

    All turbines of a series see the same direction, so the hours of a farm's few series are
    weighted by their numbers of turbines; turbine hours are never formed.
    """
    driven = turbines.groupBy("plant_id", "series_id").agg(F.count("*").alias("_n"))
    weight = F.when(F.col("direction").isNotNull(), F.col("_n"))
    return driven.join(series.select("series_id", "ts", "direction"), "series_id").groupBy(
        "plant_id", "ts"
    ).agg(F.try_divide(F.sum(F.col("direction") * F.col("_n")), F.sum(weight)).alias("mean_dir"))


def upwind_factor(offsets: DataFrame, directions: DataFrame) -> DataFrame:
    """Position of each turbine along the mean wind; largest is furthest upwind."""
    angle = geo.wind_angle(F.col("mean_dir"))
    turned = directions.select(
        "plant_id", "ts", F.sin(angle).alias("_sin"), F.cos(angle).alias("_cos")
    )
    return turned.join(offsets.select("plant_id", "turbine_id", "x_m", "y_m"), "plant_id").select(
        "plant_id",
        "ts",
        "turbine_id",
        (F.col("_sin") * F.col("x_m") + F.col("_cos") * F.col("y_m")).alias("factor"),
    )


def upwind_position(mean_dir: Column, x_m: Column, y_m: Column) -> Column:
    """The factor of ``upwind_factor`` for rows that hold the direction and the offsets."""
    angle = geo.wind_angle(mean_dir)
    return F.sin(angle) * x_m + F.cos(angle) * y_m


def upwind_rank(factors: DataFrame) -> DataFrame:
    """Rank from 1 per farm and hour; a group is one farm's turbines in one hour."""
    order = Window.partitionBy("plant_id", "ts").orderBy(F.col("factor").desc(), "turbine_id")
    return factors.withColumn("rank", F.row_number().over(order))


def lead_turbine(factors: DataFrame) -> DataFrame:
    """The rank-1 turbine per farm and hour, without sorting the group."""
    best = F.max_by("turbine_id", F.struct("factor", -F.col("turbine_id")))
    return factors.groupBy("plant_id", "ts").agg(best.alias("lead_id"))


def downwind_distance(
    direction: Column, lat0: Column, lon0: Column, lat: Column, lon: Column
) -> Column:
    """Metres that a turbine lies behind a lead turbine at ``lat0, lon0``."""
    angle = geo.wind_angle(direction)
    east = geo.east_m(lat0, lon0, lon)
    north = geo.north_m(lat0, lon0, lat)
    return -F.cos(angle) * east - F.sin(angle) * north


def mean_resistance(strings: DataFrame) -> DataFrame:
    return strings.groupBy("plant_id").agg(F.avg("ohm").alias("mean_ohm"))


def mean_hub_height(features: DataFrame) -> DataFrame:
    return features.groupBy("plant_id").agg(F.avg("hub").alias("mean_hub"))


def cable_hops(links: DataFrame, turbines: DataFrame, plants: DataFrame) -> DataFrame:
    """Consecutive pairs along each cable string; the last one ends at the PCC.

    ``links`` holds ``(plant_id, string_pos, pos, turbine_id)`` with gapless list
    positions, so the next hop is an equi-join on ``pos + 1``.
    """
    place = turbines.select("plant_id", "turbine_id", "lat", "lon", "elev")
    here = links.join(place, ["plant_id", "turbine_id"])
    after = here.select(
        "plant_id",
        "string_pos",
        (F.col("pos") - 1).alias("pos"),
        F.col("turbine_id").alias("next_id"),
        F.struct("lat", "lon", "elev").alias("_next"),
    )
    pcc = plants.select(
        "plant_id", F.struct(
            F.col("pcc_lat").alias("lat"), F.col("pcc_lon").alias("lon"), F.col("pcc_elev").alias("elev")
        ).alias("_pcc")
    )
    to = F.coalesce("_next", "_pcc")
    hop = geo.distance_km(F.col("lat"), F.col("lon"), F.col("elev"), to.lat, to.lon, to.elev)
    return (
        here.join(after, ["plant_id", "string_pos", "pos"], "left")
        .join(pcc, "plant_id")
        .select(
            "plant_id", "string_pos", "pos", "turbine_id",
            F.coalesce(F.col("next_id").cast("string"), F.lit("pcc")).alias("next_hop"),
            hop.alias("hop_km"),
        )
    )


def cable_path(hops: DataFrame, block: int = 1024) -> DataFrame:
    """Cable length from each turbine to the PCC: a suffix sum along its string.

    Positions are summed per block first; the window over a string then sees one
    row per block, and the inner window at most ``block`` rows, however long the
    string is. A turbine in several strings keeps the first one.
    """
    blocked = hops.withColumn("_block", F.floor(F.col("pos") / block))
    string = ["plant_id", "string_pos"]
    later = Window.partitionBy(*string).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    behind = (
        blocked.groupBy(*string, "_block")
        .agg(F.sum("hop_km").alias("_sum"))
        .withColumn("_behind", F.coalesce(F.sum("_sum").over(later), F.lit(0.0)))
        .drop("_sum")
    )
    rest = (
        Window.partitionBy(*string, "_block")
        .orderBy("pos")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    return (
        blocked.withColumn("_rest", F.sum("hop_km").over(rest))
        .join(behind, [*string, "_block"])
        .withColumn("path_km", F.bround(F.col("_rest") + F.col("_behind"), 4))
        .groupBy("plant_id", "turbine_id")
        .agg(F.min_by("path_km", F.struct("string_pos", "pos")).alias("path_km"))
    )

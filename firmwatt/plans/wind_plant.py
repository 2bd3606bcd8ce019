"""Wind plants end to end, all plants in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from firmwatt import schemas
from firmwatt.constants import PRESSURE_LIMIT
from firmwatt.operators import (
    curves,
    energy,
    farm_correction,
    layout,
    quality,
    turbine_power,
    wake,
)
from firmwatt.operators.cleaning import clean_wind
from firmwatt.sources import requests as plant_requests
from firmwatt.sources.files import named_series
from firmwatt.sources.sinks import stage

WEATHER = ["wind", "direction", "ta", "pressure"]


@dataclass
class WindInputs:
    """Dimension tables and the cleaned series of many wind plants.

    plants      plant_id, cen, ihf, ppi, kpc, kt, kin, kv, measured, offshore,
                pcc_lat, pcc_lon, pcc_elev, series_id
    turbines    plant_id, turbine_id, ordinal, model_id, lat, lon, elev, declared_tower
    towers      plant_id, tower_id, lat, lon, elev, radius_km, series_id
    models      model_id, hub, rotor_d, p_nom, v_nom, rho_nom, v_max, t_min, t_max
    points      model_id, idx, v, p, ct
    strings     plant_id, string_pos, ohm
    links       plant_id, string_pos, pos, turbine_id
    series      series_id, ts, wind, direction, ta, pressure
    """

    plants: DataFrame
    turbines: DataFrame
    towers: DataFrame
    models: DataFrame
    points: DataFrame
    strings: DataFrame
    links: DataFrame
    series: DataFrame


def from_requests(requests: DataFrame, series: DataFrame) -> WindInputs:
    """The inputs that wind requests describe; ``series`` has the file's name as ``series_id``."""
    return from_dimensions(plant_requests.wind_dimensions(plant_requests.accepted(requests, "wind")), series)


def from_dimensions(dims: dict[str, DataFrame], series: DataFrame) -> WindInputs:
    """The inputs from the tables of ``wind_dimensions``, parsed now or stored by the stream.

    Two plants may give the same name to different models, so a model is keyed by its
    content: equal curves of many plants are still built once.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.drop("model_id").withColumnRenamed("model_key", "model_id")

    return WindInputs(
        plants=dims["plants"].withColumnRenamed("series_file", "series_id"),
        turbines=keyed(dims["turbines"]),
        towers=dims["towers"].withColumnRenamed("series_file", "series_id"),
        models=keyed(dims["models"]).drop("plant_id").dropDuplicates(["model_id"]),
        points=keyed(dims["points"]).drop("plant_id").dropDuplicates(["model_id", "idx"]),
        strings=dims["strings"],
        links=dims["links"],
        series=series,
    )


def series_names(dims: dict[str, DataFrame]) -> DataFrame:
    """plant_id, series_file: the files that drive a plant's turbines, its towers' in measured plants."""
    plants = dims["plants"]
    own = plants.filter(~F.col("measured")).select("plant_id", "series_file")
    measured = plants.filter("measured").select("plant_id")
    return own.unionByName(dims["towers"].join(measured, "plant_id", "left_semi").select("plant_id", "series_file"))


def from_files(requests: DataFrame, folder: str) -> tuple[WindInputs, DataFrame]:
    """The inputs that wind requests describe, with their series read below ``folder``.

    A plant with a file that is missing or can't be read is left out; the second table has
    the status of every plant's files.
    """
    dims = plant_requests.wind_dimensions(plant_requests.accepted(requests, "wind"))
    found = named_series(requests.sparkSession, folder, series_names(dims), schemas.RAW_WIND, clean_wind)
    status = found.status()
    return without(from_dimensions(dims, found.series), quality.failing_plants(status)), status


def series_profile(series: DataFrame) -> DataFrame:
    """One pass over the series: per series its mean density and its faults.

    ``stamps`` counts repeated or missing time stamps, ``holes`` rows with a missing value,
    ``pressures`` rows with a pressure out of range.
    """
    missing = quality.any_missing(*WEATHER)
    by_stamp = curves.with_density(series).groupBy("series_id", "ts").agg(
        F.count("*").alias("rows"),
        F.count_if(missing).alias("holes"),
        F.count_if(F.col("pressure") >= PRESSURE_LIMIT).alias("pressures"),
        F.sum("rho").alias("rho"),
        F.count("rho").alias("n"),
    )
    return by_stamp.groupBy("series_id").agg(
        F.count_if((F.col("rows") > 1) | F.col("ts").isNull()).alias("stamps"),
        F.sum("holes").alias("holes"),
        F.sum("pressures").alias("pressures"),
        F.bround(F.try_divide(F.sum("rho"), F.sum("n")), 2).alias("rho_mean"),
    )


def status(inputs: WindInputs, profile: DataFrame | None = None) -> DataFrame:
    """What would cut turbines out of a plant or leave its energy undefined: one row per plant
    and check.

    The joins of the plan are inner joins; a turbine without a match in one of them would
    lower its plant's energy unseen. The series are checked once per series, not per turbine:
    repeated stamps and missing values would count twice or not at all. ``profile`` is the
    stored ``series_profile``, where there is one.
    """
    profile = series_profile(inputs.series) if profile is None else profile
    there = F.lit(True)
    one = lambda df, name, *keys: df.select(*keys).distinct().withColumn(name, there)
    counted = lambda df, name, *keys: df.groupBy(*keys).agg(F.count("*").alias(name))
    usable = inputs.points.groupBy("model_id").agg(
        F.countDistinct("v").alias("n_points"), F.max(quality.any_missing("v", "p", "ct")).alias("hole")
    )
    nameplate = inputs.models.groupBy("model_id").agg(
        F.count("*").alias("n_models"),
        F.max(quality.any_missing("hub", "p_nom", "v_nom", "rho_nom", "v_max")).alias("no_nameplate"),
        F.max(F.coalesce(~(F.col("rotor_d") > 0) | F.isnan("rotor_d"), F.lit(True))).alias("no_rotor"),
    )
    models = nameplate.join(usable, "model_id", "left")
    plants = inputs.plants.select("plant_id", "measured", "series_id")
    towers = inputs.towers.join(plants.filter("measured").select("plant_id"), "plant_id", "left_semi")
    place = ["plant_id", "turbine_id"]
    turbines = (
        inputs.turbines.withColumn("tower_id", F.col("declared_tower"))
        .join(models, "model_id", "left")
        .join(one(inputs.links, "cabled", *place), place, "left")
        .join(plants.select("plant_id", "measured"), "plant_id", "left")
        .join(one(towers, "known_tower", "plant_id", "tower_id"), ["plant_id", "tower_id"], "left")
        .join(counted(inputs.turbines, "n_turbines", *place), place, "left")
    )
    few = ~F.coalesce(F.col("n_points") >= curves.LEAST_POINTS, F.lit(False)) | F.col("hole")
    cables = inputs.links.join(one(inputs.turbines, "known", *place), place, "left")
    sites = inputs.plants.join(
        inputs.strings.groupBy("plant_id").agg(F.max(quality.any_missing("ohm")).alias("no_ohm")), "plant_id", "left"
    )
    sites = sites.join(counted(inputs.plants, "n_plants", "plant_id"), "plant_id", "left").join(
        counted(inputs.turbines, "n_turbines", "plant_id"), "plant_id", "left"
    )
    masts = towers.join(counted(towers, "n_towers", "plant_id", "tower_id"), ["plant_id", "tower_id"], "left")
    driven = plants.filter(~F.col("measured")).select("plant_id", "series_id").union(towers.select("plant_id", "series_id"))
    weather = driven.join(profile, "series_id", "left")
    repeated = "repeated row of a plant, turbine, tower or model"
    return quality.plant_status(
        quality.violations_of(
            turbines,
            ("models", "turbine model unknown or with fewer than 4 points", few),
            ("cables", "turbine without a cable", F.col("cabled").isNull()),
            (
                "towers",
                "turbine with an unknown tower",
                F.col("measured") & F.col("declared_tower").isNotNull() & F.col("known_tower").isNull(),
            ),
            ("coordinates", "latitude or longitude out of range", quality.outside("lat", "lon")),
            ("distance", "missing elevation", quality.any_missing("elev")),
            ("wake_radius", "rotor without a diameter", F.col("no_rotor")),
            ("nameplate", "missing value in a turbine model", F.col("no_nameplate")),
            ("repeated", repeated, (F.col("n_turbines") > 1) | (F.col("n_models") > 1)),
        ),
        quality.violations_of(cables, ("links", "cable to an unknown turbine", F.col("known").isNull())),
        quality.violations_of(
            masts,
            ("coordinates", "latitude or longitude out of range", quality.outside("lat", "lon")),
            ("distance", "missing elevation", quality.any_missing("elev", "radius_km")),
            ("repeated", repeated, F.col("n_towers") > 1),
        ),
        quality.violations_of(
            sites,
            ("strings", "plant without cable strings or resistance", F.coalesce("no_ohm", there)),
            ("coordinates", "latitude or longitude out of range", quality.outside("pcc_lat", "pcc_lon")),
            ("distance", "missing elevation", quality.any_missing("pcc_elev")),
            ("plant", "missing value of a plant", quality.any_missing("kv", "kpc", "kt", "kin", "ihf", "ppi")),
            ("turbines", "plant without a turbine", F.col("n_turbines").isNull()),
            ("repeated", repeated, F.col("n_plants") > 1),
        ),
        quality.violations_of(
            weather,
            ("series", "no weather for a tower or plant", F.col("stamps").isNull()),
            ("stamps", "repeated or missing time stamp", F.col("stamps") > 0),
            ("values", "missing value in " + ", ".join(WEATHER), F.col("holes") > 0),
            ("pressure", "atmospheric pressure out of range", F.col("pressures") > 0),
        ),
    )


def curve_status(inputs: WindInputs, armed: DataFrame) -> DataFrame:
    """Turbines that lost their curve to the top-speed limit, or were lost on the way to the
    stored ``armed`` turbines."""
    place = ["plant_id", "turbine_id"]
    found = armed.select(*place, F.col("curve").isNull().alias("no_curve"))
    return quality.violations_of(
        inputs.turbines.select(*place).join(found, place, "left"),
        ("curves", "curve with fewer than 4 points at the site's density", F.col("no_curve")),
        ("turbines", "turbine without weather, tower or model", F.col("no_curve").isNull()),
    )


def undefined_thrust() -> Column:
    thrust = F.col("thrust")
    return thrust.isNull() | F.isnan(thrust) | (F.abs(thrust) == float("inf"))


def thrust_status(hours: DataFrame) -> DataFrame:
    """Turbine hours whose thrust is no finite number; the wake would spread it unseen."""
    return quality.violations_of(hours, ("thrust", "thrust coefficient is not a number", undefined_thrust()))


def without(inputs: WindInputs, failing: DataFrame) -> WindInputs:
    """The inputs without the failing plants."""
    keep = lambda df: df.join(failing, "plant_id", "left_anti")
    return replace(inputs, plants=keep(inputs.plants), turbines=keep(inputs.turbines), links=keep(inputs.links))


def accepted_inputs(inputs: WindInputs) -> WindInputs:
    """The inputs without the plants that fail a check; they are reported by ``status``."""
    # a small table, read by several joins
    return without(inputs, stage(quality.failing_plants(status(inputs))))


def assigned_turbines(inputs: WindInputs) -> DataFrame:
    """Turbines with the series that drives them: their tower's in measured
    plants, the plant's own elsewhere."""
    site = inputs.plants.select(
        "plant_id", "measured", "offshore", F.col("series_id").alias("plant_series")
    )
    turbines = layout.terrain_constants(inputs.turbines.join(site, "plant_id"))
    measured = turbines.filter("measured")
    chosen = layout.nearest_tower(measured, inputs.towers).select(
        "plant_id", "turbine_id", "tower_id"
    )
    tower_series = inputs.towers.select("plant_id", "tower_id", "series_id")
    with_tower = (
        measured.join(chosen, ["plant_id", "turbine_id"])
        .join(tower_series, ["plant_id", "tower_id"])
        .drop("tower_id", "plant_series")
    )
    without = turbines.filter(~F.col("measured")).withColumnRenamed("plant_series", "series_id")
    return with_tower.unionByName(without)


def static_turbines(inputs: WindInputs, profile: DataFrame | None = None) -> DataFrame:
    """Turbines with everything that does not change by the hour but their curve.

    ``profile`` is the stored ``series_profile``, where there is one.
    """
    if profile is None:
        densities = curves.mean_density(curves.with_density(inputs.series))
    else:
        densities = profile.select("series_id", "rho_mean")
    turbines = layout.turbine_features(assigned_turbines(inputs), inputs.models)
    path = layout.cable_path(layout.cable_hops(inputs.links, inputs.turbines, inputs.plants))
    losses = inputs.plants.select("plant_id", "kv", "kpc", "kt", "kin").join(
        layout.mean_resistance(inputs.strings), "plant_id"
    )
    return (
        layout.local_offsets(turbines)
        .join(densities, "series_id")
        .join(path, ["plant_id", "turbine_id"])
        .join(losses, "plant_id")
    )


def segments_in_use(inputs: WindInputs, turbines: DataFrame) -> DataFrame:
    """Curve segments of every model at every mean density it runs at."""
    in_use = turbines.select("model_id", "rho_mean").distinct()
    return curves.curve_segments(curves.correct_curves(inputs.points, inputs.models, in_use))


def free_speeds(turbines: DataFrame, series: DataFrame) -> DataFrame:
    """Turbine hours before wakes, with the large-farm correction applied offshore."""
    place = ["plant_id", "turbine_id", "series_id", "lat", "lon", "hub", "rotor_d", "z01", "z02"]
    onshore = layout.fan_out_series(
        turbines.filter(~F.col("offshore")).select(*place), series
    )
    at_sea = turbines.filter("offshore")
    described = at_sea.select(*place, "x_m", "y_m").join(layout.mean_hub_height(at_sea), "plant_id")
    hours = layout.fan_out_series(described, series)
    corrected = farm_correction.offshore_speeds(hours, layout.mean_direction(at_sea, series))
    columns = ["plant_id", "turbine_id", "ts", "wind", "direction", "ta", "rho"]
    return onshore.select(*columns).unionByName(corrected.select(*columns))


def wake_inputs(armed: DataFrame, free: DataFrame, steps: int) -> DataFrame:
    """Turbine hours as the wake needs them, with each source's thrust. ``armed`` are the
    turbines with their ``curve``."""
    attributes = armed.select("plant_id", "turbine_id", "rho_nom", "radius", "cre", "curve")
    return wake.source_thrust(free.join(attributes, ["plant_id", "turbine_id"]), steps).drop("curve")


def rated_power(slowed: DataFrame, armed: DataFrame, steps: int) -> DataFrame:
    """Power of the turbine hours behind the wakes."""
    rated = armed.select(
        "plant_id", "turbine_id", "rho_nom", "p_nom", "t_min", "t_max",
        "path_km", "kv", "mean_ohm", "kpc", "kt", "kin", "curve",
    )
    return turbine_power.turbine_power(slowed.join(rated, ["plant_id", "turbine_id"]), steps)


@dataclass
class Checked:
    """Hourly energy of the plants that pass all checks, and the outcome of every check."""

    hourly: DataFrame
    status: DataFrame


def checked_energy(inputs: WindInputs) -> Checked:
    """The plan, with its checks where their data pass anyway.

    The series are profiled in the pass that gives their mean density. Lost curves show in the
    stored turbines. The stored thrust is observed while it is written; only if any of it
    is undefined are the plants counted. A plant that fails leaves before the next stage.

    Five stages are stored: the profile, the static turbines with their curves, the curve
    segments, the turbines' tiles and the hourly thrust. Each is read more than once afterwards.
    """
    profile = stage(series_profile(inputs.series))
    found = stage(status(inputs, profile))
    passing = without(inputs, quality.failing_plants(found))
    turbines = stage(static_turbines(passing, profile))
    segments = stage(segments_in_use(passing, turbines))
    steps = curves.lookup_steps(segments)
    armed = stage(curves.with_curves(turbines, segments))
    lost = stage(curve_status(passing, armed))
    found, failing = found.unionByName(lost), quality.failing_plants(lost)
    if not failing.isEmpty():
        passing, armed = without(passing, failing), armed.join(failing, "plant_id", "left_anti")
    free = free_speeds(armed, curves.with_density(inputs.series))
    seen = Observation()
    thrust = wake_inputs(armed, free, steps).observe(seen, F.count_if(undefined_thrust()).alias("undefined"))
    hours = stage(thrust)
    if seen.get["undefined"]:
        bad = stage(thrust_status(hours))
        found, failing = found.unionByName(bad), quality.failing_plants(bad)
        passing, hours = without(passing, failing), hours.join(failing, "plant_id", "left_anti")
    tiles = stage(wake.sector_tiles(armed))
    power = rated_power(wake.wake_speeds(hours, tiles), armed, steps)
    return Checked(energy.hourly_energy_wind(power, passing.plants), found)


def hourly_energy(inputs: WindInputs) -> DataFrame:
    """Hourly energy of the plants that pass all checks."""
    return checked_energy(inputs).hourly


def results(hourly: DataFrame, plants: DataFrame) -> dict[str, DataFrame]:
    """The five result tables from the plants' hourly energy."""
    monthly = energy.monthly_energy(hourly)
    daily = energy.daily_equivalent(monthly)
    firm = energy.firm_energy_wind(daily, plants)
    surplus = energy.daily_surplus(daily, firm)
    return {
        "hourly": energy.out_hourly(hourly),
        "monthly": energy.out_monthly(monthly),
        "daily": energy.out_daily(daily),
        "firm": energy.out_firm(firm),
        "surplus": energy.out_surplus(surplus),
    }

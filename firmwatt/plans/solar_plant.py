"""Solar plants end to end, all plants in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt import schemas
from firmwatt.constants import INVERTER_LEVELS, POINTS_PER_LEVEL
from firmwatt.operators import array_power, cleaning, energy, inverter, irradiance, quality
from firmwatt.sources import requests as plant_requests
from firmwatt.sources.files import named_series
from firmwatt.sources.series import dealt
from firmwatt.sources.sinks import stage

#: Parameters of the single-diode circuit.
CIRCUIT = ["a_ref", "il_ref", "i0_ref", "rs_ref", "rsh_ref", "adjust"]

#: Array hours of a task.
PART_ROWS = 250_000


@dataclass
class SolarInputs:
    """Dimension tables and the cleaned series of many solar plants.

    plants     plant_id, lat, lon, tz, albedo, l_pct, cen, ihf, ppi, kpc, kt, kin, measured
    inverters  plant_id, inverter_id, n_inv, paco, pdco, vdco, pso, pnt,
               p_dc_points, p_ac_points
    arrays     plant_id, inverter_id, array_id, tracker, axis_az, axis_tilt, max_angle,
               modules_per_string, strings
    modules    plant_id, inverter_id, t_noct, psi, bifacial, bifaciality, alpha_sc, a_ref, il_ref,
               i0_ref, rs_ref, rsh_ref, adjust
    series     plant_id, ts, ghi, ta, back_irradiance
    """

    plants: DataFrame
    inverters: DataFrame
    arrays: DataFrame
    modules: DataFrame
    series: DataFrame


def from_requests(requests: DataFrame, series: DataFrame, circuits: DataFrame) -> SolarInputs:
    """The inputs that solar requests describe. The requests are parsed once: their tables are
    stored, so their sizes are known where the series fan out."""
    dims = plant_requests.solar_dimensions(stage(plant_requests.accepted(requests, "solar")))
    return from_dimensions({name: stage(rows) for name, rows in dims.items()}, series, circuits)


def from_dimensions(dims: dict[str, DataFrame], series: DataFrame, circuits: DataFrame) -> SolarInputs:
    """The inputs from the tables of ``solar_dimensions``, parsed now or stored by the stream.

    ``series`` has the file's name as ``series_id``. ``circuits`` has the six circuit
    parameters by ``module_model``; a module that it lacks keeps them NULL.
    """
    parameters = circuits.select("module_model", *CIRCUIT)
    files = dims["plants"].select("plant_id", F.col("series_file").alias("series_id"))
    return SolarInputs(
        plants=dims["plants"].drop("series_file"),
        inverters=dims["inverters"],
        arrays=dims["arrays"],
        modules=dims["modules"].join(parameters, "module_model", "left"),
        series=dealt(series).join(files, "series_id").drop("series_id"),
    )


def from_files(requests: DataFrame, folder: str, circuits: DataFrame) -> tuple[SolarInputs, DataFrame]:
    """The inputs that solar requests describe, with their series read below ``folder``.

    A plant whose file is missing or can't be read is left out; the second table has the status
    of every plant's file. The files hold no back irradiance: it is NULL, which fails the
    plants with bifacial modules.
    """
    dims = plant_requests.solar_dimensions(plant_requests.accepted(requests, "solar"))
    names = dims["plants"].select("plant_id", "series_file")
    found = named_series(requests.sparkSession, folder, names, schemas.RAW_SOLAR, cleaning.clean_solar)
    series = found.series.withColumn("back_irradiance", F.lit(None).cast("double"))
    status = found.status()
    return without(from_dimensions(dims, series, circuits), quality.failing_plants(status)), status


def status(inputs: SolarInputs, fit: DataFrame) -> DataFrame:
    """Inverters whose points or fit are not valid; they would be missing in a plant's sum."""
    points = len(INVERTER_LEVELS) * POINTS_PER_LEVEL
    short = (F.coalesce(F.size("p_dc_points"), F.lit(-1)) != points) | (
        F.coalesce(F.size("p_ac_points"), F.lit(-1)) != points
    )
    fitted = inputs.inverters.select(*inverter.KEY).join(fit, inverter.KEY, "left")
    return quality.plant_status(
        quality.violations(inputs.inverters, short, "inverter_points", "inverter without all measured points"),
        quality.check_inverter_fit(fitted),
    )


def site_status(inputs: SolarInputs) -> DataFrame:
    """What would cut inverters or arrays out of a plant's sum, or count them twice: rows that
    find no partner in the plan's inner joins, missing values, repeated rows."""
    key, array_key = inverter.KEY, [*inverter.KEY, "array_id"]
    counted = lambda df, name, *keys: df.groupBy(*keys).agg(F.count("*").alias(name))
    back = F.col("bifacial") & quality.any_missing("bifaciality")
    module = inputs.modules.groupBy(*key).agg(
        F.count("*").alias("n_modules"),
        F.max(quality.any_missing("t_noct", "psi", "alpha_sc") | F.col("bifacial").isNull() | back).alias("no_module"),
        F.max(quality.any_missing(*CIRCUIT)).alias("no_circuit"),
    )
    inverters = (
        inputs.inverters.join(module, key, "left")
        .join(counted(inputs.arrays, "n_arrays", *key), key, "left")
        .join(counted(inputs.inverters, "n_inverters", *key), key, "left")
    )
    known = inputs.inverters.select(*key).distinct().withColumn("known", F.lit(True))
    arrays = inputs.arrays.join(known, key, "left").join(counted(inputs.arrays, "n_arrays", *array_key), array_key, "left")
    tracker = F.col("tracker").isNull() | (F.col("tracker") & quality.any_missing("max_angle"))
    plants = inputs.plants.join(counted(inputs.plants, "n_plants", "plant_id"), "plant_id", "left").join(
        counted(inputs.inverters, "n_inverters", "plant_id"), "plant_id", "left"
    )
    repeated = "repeated row of a plant, inverter, module or array"
    return quality.plant_status(
        quality.violations_of(
            plants,
            ("coordinates", "latitude or longitude out of range", quality.outside("lat", "lon")),
            (
                "plant",
                "missing value of a plant",
                F.col("tz").isNull() | quality.any_missing("albedo", "l_pct", "kpc", "kt", "kin", "ihf", "ppi"),
            ),
            ("inverters", "plant without an inverter", F.col("n_inverters").isNull()),
            ("repeated", repeated, F.col("n_plants") > 1),
        ),
        quality.violations_of(
            inverters,
            ("modules", "inverter without a module or with a missing value of it", F.coalesce("no_module", F.lit(True))),
            ("circuits", "module without all circuit parameters", F.col("no_circuit")),
            ("arrays", "inverter without an array", F.col("n_arrays").isNull()),
            (
                "inverters",
                "missing value of an inverter",
                quality.any_missing("paco", "pdco", "vdco", "pso", "pnt", "n_inv"),
            ),
            ("repeated", repeated, (F.col("n_inverters") > 1) | (F.col("n_modules") > 1)),
        ),
        quality.violations_of(
            arrays,
            ("arrays", "array of an unknown inverter", F.col("known").isNull()),
            (
                "array_values",
                "missing value of an array",
                tracker | quality.any_missing("axis_az", "axis_tilt", "modules_per_string", "strings"),
            ),
            ("repeated", repeated, F.col("n_arrays") > 1),
        ),
    )


def series_status(inputs: SolarInputs, series: DataFrame) -> DataFrame:
    """Plants without weather, with repeated or missing stamps or with missing values; the back
    irradiance counts where a module uses it. ``series`` may be what the plan derived from it."""
    bifacial = inputs.modules.filter("bifacial").select("plant_id").distinct().withColumn("two_faces", F.lit(True))
    by_stamp = series.groupBy("plant_id", "ts").agg(
        F.count("*").alias("rows"),
        F.count_if(quality.any_missing("ghi", "ta")).alias("holes"),
        F.count_if(quality.any_missing("back_irradiance")).alias("dark"),
    )
    faults = by_stamp.groupBy("plant_id").agg(
        F.count_if((F.col("rows") > 1) | F.col("ts").isNull()).alias("stamps"),
        F.sum("holes").alias("holes"),
        F.sum("dark").alias("dark"),
    )
    plants = inputs.plants.select("plant_id").join(faults, "plant_id", "left").join(bifacial, "plant_id", "left")
    return quality.violations_of(
        plants,
        ("series", "no weather for a plant", F.col("stamps").isNull()),
        ("stamps", "repeated or missing time stamp", F.col("stamps") > 0),
        ("values", "missing value in ghi, ta or back_irradiance", (F.col("holes") > 0) | (F.col("two_faces") & (F.col("dark") > 0))),
    )


def without(inputs: SolarInputs, failing: DataFrame) -> SolarInputs:
    """The inputs without the failing plants."""
    keep = lambda df: df.join(failing, "plant_id", "left_anti")
    return replace(inputs, plants=keep(inputs.plants), inverters=keep(inputs.inverters), arrays=keep(inputs.arrays))


def accepted_inputs(inputs: SolarInputs, fit: DataFrame) -> SolarInputs:
    """The inputs without the plants that fail a check; they are reported by ``status``."""
    found = quality.plant_status(status(inputs, fit), site_status(inputs), series_status(inputs, inputs.series))
    return without(inputs, stage(quality.failing_plants(found)))


def static_arrays(inputs: SolarInputs) -> DataFrame:
    """Arrays with everything that does not change by the hour."""
    site = inputs.plants.select("plant_id", "albedo", "l_pct")
    return inputs.arrays.join(site, "plant_id").join(inputs.modules, inverter.KEY)


def is_day() -> Column:
    """Whether an hour counts: daylight with any irradiance."""
    return cleaning.is_daylight() & cleaning.is_lit()


def plane_of_arrays(hours: DataFrame, arrays: DataFrame) -> DataFrame:
    """``poa`` and ``ta`` per array and hour, for every hour of the series.

    ``hours`` is the irradiance by plant. Only lit daylight hours count; all others
    keep their row with 0. The lit flag travels with the row, so the full index never
    has to be joined back.
    """
    lit_hours = hours.withColumn("lit", is_day())
    facing = irradiance.surface_orientation(lit_hours.join(arrays, "plant_id"))
    front = irradiance.plane_irradiance(facing).withColumnRenamed("back_irradiance", "poa_back")
    poa = F.nanvl(F.when(F.col("lit"), F.col("poa")), F.lit(0.0))
    return irradiance.combine_faces(front).withColumn("poa", F.coalesce(poa, F.lit(0.0)))


def array_output(arrays: DataFrame) -> DataFrame:
    """DC current, voltage and power of each array per hour, after DC losses. ``arrays`` is
    the irradiance on them."""
    df = array_power.panel_temperature(arrays)
    df = array_power.max_power_point(array_power.circuit_params(df))
    return array_power.dc_losses(array_power.string_scaling(df))


def by_plant_hour(hours: DataFrame, arrays: DataFrame) -> DataFrame:
    """The hours dealt by plant and stamp, in parts of about ``PART_ROWS`` array hours.

    What follows is grouped by inverter and hour, then by plant and hour: where the arrays are
    broadcast, no array hour is shuffled, and a task's groups keep their size as plants grow in
    number. Both tables should be stored, as their rows are counted.
    """
    many, plants = arrays.agg(F.count("*"), F.countDistinct("plant_id")).first()
    parts = -(-hours.count() * many // (max(plants, 1) * PART_ROWS))
    return hours.repartition(max(hours.sparkSession.sparkContext.defaultParallelism, parts), "plant_id", "ts")


def inverter_hours(hours: DataFrame, arrays: DataFrame) -> DataFrame:
    """AC power per inverter for every hour of the series. ``arrays`` carry their nameplate.

    An array gives nothing in an hour without light, so what its inverter then shows is the
    same in each of them: it is found once per inverter, and only lit hours meet the arrays.
    """
    dealt_hours = by_plant_hour(hours, arrays).withColumn("day", F.coalesce(is_day(), F.lit(False)))
    day = array_output(plane_of_arrays(dealt_hours.filter("day"), arrays))
    nothing = {c: F.lit(0.0) for c in ("i_sc", "v_oc", "i_mp", "v_mp", "p_mp", "i_x", "i_xx")}
    idle = array_power.dc_losses(array_power.string_scaling(arrays.withColumns(nothing)))
    idle = inverter.inverter_output(idle.withColumn("ts", F.lit(None).cast("timestamp_ntz"))).drop("ts")
    night = dealt_hours.groupBy("plant_id", "ts").agg(F.bool_or("day").alias("day")).filter("not day")
    return inverter.inverter_output(day).unionByName(night.select("plant_id", "ts").join(idle, "plant_id"))


@dataclass
class Checked:
    """Hourly energy of the plants that pass all checks, and the outcome of every check."""

    hourly: DataFrame
    status: DataFrame


def checked_energy(inputs: SolarInputs) -> Checked:
    """The plan, with its checks where their data pass anyway.

    Tables are checked first. The stored irradiance holds each row of the series that is
    left, so the series themselves are read once and checked there; a plant that fails
    leaves before its hours meet its arrays. Both sides of that fan-out are stored, so the
    optimizer knows their true sizes and picks the side to broadcast, or none, by them. The
    arrays carry their inverter's nameplate, so array hours are joined with nothing more.
    """
    fit = stage(inverter.inverter_fit(inverter.inverter_samples(inputs.inverters)))
    found = stage(quality.plant_status(status(inputs, fit), site_status(inputs)))
    passing = without(inputs, quality.failing_plants(found))
    hours = stage(irradiance.irradiance_by_plant(inputs.series, passing.plants))
    seen = stage(series_status(passing, hours))
    found, failing = found.unionByName(seen), quality.failing_plants(seen)
    if not failing.isEmpty():
        passing, hours = without(passing, failing), hours.join(failing, "plant_id", "left_anti")
    static = stage(inverter.with_nameplate(static_arrays(passing), passing.inverters, fit))
    ac = inverter_hours(hours, static)
    return Checked(inverter.plant_losses(energy.hourly_energy_solar(ac), passing.plants), found)


def hourly_energy(inputs: SolarInputs) -> DataFrame:
    """Hourly energy of the plants that pass all checks."""
    return checked_energy(inputs).hourly


def results(hourly: DataFrame, plants: DataFrame) -> dict[str, DataFrame]:
    """The five result tables from the plants' hourly energy."""
    monthly = energy.monthly_energy(hourly)
    daily = energy.daily_equivalent(monthly)
    firm = energy.firm_energy_solar(daily, plants)
    surplus = energy.daily_surplus(daily, firm)
    return {
        "hourly": energy.out_hourly(hourly),
        "monthly": energy.out_monthly(monthly),
        "daily": energy.out_daily(daily),
        "firm": energy.out_firm(firm),
        "surplus": energy.out_surplus(surplus),
    }

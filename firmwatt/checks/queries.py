"""The registered queries: one per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmwatt.checks import tables as T
from firmwatt.constants import TECHNOLOGY_CODES
from firmwatt.functions import geo
from firmwatt.functions.numeric import capped, floored
from firmwatt.operators import (
    array_power,
    cleaning,
    curves,
    energy,
    farm_correction,
    inverter,
    irradiance,
    layout,
    quality,
    turbine_power,
    wake,
)
from firmwatt.plans import solar_plant, wind_plant
from firmwatt.session import tune
from firmwatt.sources import files, requests, series, sinks
from firmwatt.streaming.requests import append_to, dead_letters, dimensions_of, fan_out_to, ingest_requests

Query = Callable[[SparkSession, str], DataFrame]

# Stored stages that several queries read, per application and data folder.
_STAGES: dict[tuple, DataFrame] = {}


def forget_stages() -> None:
    _STAGES.clear()


def _stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGES:
        _STAGES[key] = sinks.stage(build())
    return _STAGES[key]


def num(name: str, digits: int = 4, value: Column | str | None = None) -> Column:
    column = F.col(name) if value is None else F.col(value) if isinstance(value, str) else value
    return F.bround(column.cast("double"), digits).alias(name)


def stamp(name: str = "ts") -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _ym() -> list[Column]:
    return [F.year("month").alias("year"), F.month("month").alias("month")]


# --- shared inputs ---------------------------------------------------------------------


def _turbines(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(
        spark, sf, "turbines", lambda: wind_plant.static_turbines(T.wind_inputs(spark, sf))
    )


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(
        spark, sf, "segments",
        lambda: wind_plant.segments_in_use(T.wind_inputs(spark, sf), _turbines(spark, sf)),
    )


def _steps(spark: SparkSession, sf: str) -> int:
    return curves.lookup_steps(_segments(spark, sf))


def _armed(spark: SparkSession, sf: str) -> DataFrame:
    """Turbines with their curves."""
    build = lambda: curves.with_curves(_turbines(spark, sf), _segments(spark, sf))
    return _stored(spark, sf, "armed", build)


def _air(spark: SparkSession, sf: str) -> DataFrame:
    return curves.with_density(T.wind_inputs(spark, sf).series)


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    return layout.fan_out_series(_turbines(spark, sf), _air(spark, sf))


def _thrust(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        armed = _armed(spark, sf)
        free = wind_plant.free_speeds(armed, _air(spark, sf))
        return wind_plant.wake_inputs(armed, free, _steps(spark, sf))

    return _stored(spark, sf, "thrust", build)


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "tiles", lambda: wake.sector_tiles(_turbines(spark, sf)))


def _power(spark: SparkSession, sf: str) -> DataFrame:
    slowed = wake.wake_speeds(_thrust(spark, sf), _tiles(spark, sf))
    return wind_plant.rated_power(slowed, _armed(spark, sf), _steps(spark, sf))


def _behind(spark: SparkSession, sf: str) -> DataFrame:
    hours, turbines = _hours(spark, sf), _turbines(spark, sf)
    factors = _factors(spark, sf)
    return farm_correction.behind_lead(hours, layout.lead_turbine(factors), turbines)


def _irradiance(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        inputs = T.solar_inputs(spark, sf)
        return irradiance.irradiance_by_plant(inputs.series, inputs.plants)

    return _stored(spark, sf, "irradiance", build)


def _plane(spark: SparkSession, sf: str) -> DataFrame:
    arrays = _stored(
        spark, sf, "arrays", lambda: solar_plant.static_arrays(T.solar_inputs(spark, sf))
    )
    return solar_plant.plane_of_arrays(_irradiance(spark, sf), arrays)


def _circuit(spark: SparkSession, sf: str) -> DataFrame:
    return array_power.circuit_params(array_power.panel_temperature(_plane(spark, sf)))


def _fit(spark: SparkSession, sf: str) -> DataFrame:
    return inverter.inverter_fit(inverter.inverter_samples(T.inverters(spark, sf)))


def _ac(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        inputs = T.solar_inputs(spark, sf)
        return inverter.with_nameplate(solar_plant.static_arrays(inputs), inputs.inverters, _fit(spark, sf))

    return solar_plant.inverter_hours(_irradiance(spark, sf), _stored(spark, sf, "rated", build))


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return energy.monthly_energy(T.metered_energy(spark, sf))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return energy.daily_equivalent(_monthly(spark, sf))


def _firm(spark: SparkSession, sf: str) -> DataFrame:
    return energy.firm_energy_solar(_daily(spark, sf), T.metered_plants(spark, sf))


def _surplus(spark: SparkSession, sf: str) -> DataFrame:
    daily = _daily(spark, sf)
    return energy.daily_surplus(daily, energy.firm_energy_solar(daily, T.metered_plants(spark, sf)))


# --- scans, sources, sinks -------------------------------------------------------------

READING = ["direction", "pressure", "ta", "wind"]


def scan_series(spark: SparkSession, sf: str) -> DataFrame:
    return T.station_readings(spark, sf).select(
        "plant_id", "event_id", stamp(), *[num(c) for c in READING]
    )


def scan_towers(spark: SparkSession, sf: str) -> DataFrame:
    towers = sinks.stage(T.towers(spark, sf).select("plant_id", "tower_id", "series_id"))
    columns = ["event_id", stamp(), *[num(c) for c in READING]]
    tagged = series.tag_towers(T.raw_wind(spark, sf), towers, "series_id", columns)
    return tagged.select("plant_id", "tower_id", "event_id", "ts", *READING)


def series_files(spark: SparkSession, sf: str) -> DataFrame:
    """The stations' readings written as one series each and read by name.

    Every station names its own series, every third one a second that is not there, and the
    last one a third with parts that are no parquet beside those that are.
    """
    base = sinks.shared_folder(spark)
    raw = T.raw_wind(spark, sf).drop("event_id")
    own = raw.withColumn("station", F.format_string("%d.parquet", "series_id")).drop("series_id")
    own.write.partitionBy("station").parquet(base)
    last = raw.filter(F.col("series_id") == T.STATIONS - 1).drop("series_id")
    last.write.parquet(f"{base}/half.parquet")
    last.select("Ano").write.mode("append").text(f"{base}/half.parquet")
    stations = spark.range(T.STATIONS).select(F.col("id").alias("plant_id"))
    name = lambda pattern: F.format_string(pattern, "plant_id").alias("series_file")
    names = (
        stations.select("plant_id", name("station=%d.parquet"))
        .unionByName(stations.filter("plant_id % 3 = 0").select("plant_id", name("station=%d-b.parquet")))
        .unionByName(stations.filter(F.col("plant_id") == T.STATIONS - 1).select("plant_id", F.lit("half.parquet").alias("series_file")))
    )
    found = files.named_series(spark, base, names, series.schemas.RAW_WIND, series.clean_wind)
    span = found.series.groupBy("series_id").agg(
        F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("wind").alias("top")
    )
    rows = found.files.join(span, F.col("series_file") == F.col("series_id"), "left")
    return rows.select("plant_id", "series_file", "problem", "rows", stamp("first"), stamp("last"), num("top"))


def _dim_rows(df: DataFrame, dim: str, item: Column, value: str) -> DataFrame:
    return df.select(
        "plant_id", F.lit(dim).alias("dim"), item.cast("string").alias("item"), num("value", 6, value)
    )


def config_to_dims(spark: SparkSession, sf: str) -> DataFrame:
    return _wind_dims(requests.wind_dimensions(T.wind_requests(spark, sf)))


def _wind_dims(dims: dict[str, DataFrame]) -> DataFrame:
    rows = _dim_rows
    links = dims["links"].join(dims["strings"], ["plant_id", "string_pos"])
    return (
        rows(dims["turbines"], "turbine", F.col("turbine_id"), "lat")
        .unionByName(rows(dims["towers"], "tower", F.col("tower_id"), "radius_km"))
        .unionByName(rows(dims["points"], "point", F.concat_ws(":", "model_id", "idx"), "p"))
        .unionByName(rows(links, "link", F.concat_ws(":", "string_pos", "pos", "turbine_id"), "ohm"))
        .unionByName(rows(dims["plants"], "plant", F.lit("cen"), "cen"))
    )


def dispatch_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return requests.dispatch_log(T.plain_requests(spark, sf))


def write_result_tables(spark: SparkSession, sf: str) -> DataFrame:
    plants = T.metered_plants(spark, sf)
    written = sinks.write_results(
        T.metered_energy(spark, sf),
        sinks.shared_folder(spark),
        lambda hourly: solar_plant.results(hourly, plants),
    )
    counts = [
        df.groupBy(F.lit(name).alias("result")).agg(F.count("*").alias("rows"))
        for name, df in written.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


def _sent(spark: SparkSession, sf: str) -> DataFrame:
    return T.metered_plants(spark, sf).selectExpr(
        "plant_id",
        "concat('results/', plant_id) AS result_file",
        "concat('run-', plant_id) AS transaction_id",
    )


def result_payload(spark: SparkSession, sf: str) -> DataFrame:
    firm, surplus = _firm(spark, sf), _surplus(spark, sf)
    return sinks.result_payload(energy.out_firm(firm), energy.out_surplus(surplus), _sent(spark, sf))


def failure_payload(spark: SparkSession, sf: str) -> DataFrame:
    status = quality.check_coordinates(T.metered_plants(spark, sf))
    return sinks.failure_payload(status, _sent(spark, sf))


def request_status(spark: SparkSession, sf: str) -> DataFrame:
    return requests.request_status(T.plain_requests(spark, sf))


def accepted_plants(spark: SparkSession, sf: str) -> DataFrame:
    plants = T.metered_plants(spark, sf)
    return quality.accepted(plants, quality.check_coordinates(plants)).select("plant_id")


def write_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.shared_folder(spark)
    sinks.write_csv(energy.out_monthly(_monthly(spark, sf)), path)
    return spark.read.schema(
        "plant_id bigint, year int, month int, energy_kwh_month double"
    ).csv(path, header=True)


def plant_status(spark: SparkSession, sf: str) -> DataFrame:
    readings = T.station_readings(spark, sf)
    scaled = readings.withColumn("pressure", F.col("pressure") * 3)
    status = quality.plant_status(
        quality.check_pressure(scaled),
        quality.check_duplicates(readings, ["plant_id", "ts"]),
        quality.check_nulls(readings, ["wind", "ta"]),
    )
    return status.select("plant_id", "task", "message", "n_bad")


# --- projections, filters, scalar functions --------------------------------------------


def parse_decimal_comma(spark: SparkSession, sf: str) -> DataFrame:
    parsed = cleaning.parse_numbers(T.raw_wind(spark, sf), {"VelocidadViento": "value"})
    return parsed.select("event_id", num("value", 6))


def build_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    stamped = cleaning.add_stamp(T.raw_wind(spark, sf)).withColumn("tz", F.lit("America/Bogota"))
    return cleaning.add_utc(stamped).select("event_id", stamp(), stamp("ts_utc"))


def scale_ghi(spark: SparkSession, sf: str) -> DataFrame:
    events = T.table(spark, sf, "events").withColumnRenamed("value", "ghi_kwh")
    return cleaning.scale_ghi(events).select("event_id", num("ghi"))


def daylight_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.daylight(T.table(spark, sf, "events")).select("event_id", stamp())


def drop_dark_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_dark(_irradiance(spark, sf)).select(
        "plant_id", stamp(), num("dni", 6), num("dhi", 6)
    )


def low_sun_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clamp_low_sun(_irradiance(spark, sf)).select(
        "plant_id", stamp(), num("dni", 6), num("dhi", 6)
    )


def cap_interconnection(spark: SparkSession, sf: str) -> DataFrame:
    lines = T.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS plant_id", "l_orderkey", "l_linenumber", "l_quantity * 1000 AS kwh"
    )
    return energy.cap_interconnection(lines, T.metered_plants(spark, sf)).select(
        "plant_id", "l_orderkey", "l_linenumber", num("kwh")
    )


def floor_zero(spark: SparkSession, sf: str) -> DataFrame:
    events = T.table(spark, sf, "events")
    return events.select("event_id", num("value", 4, floored(F.col("value") - 10)))


def temperature_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = turbine_power.within_temperature(
        F.col("value"), F.lit(15) + F.col("user_id") % 20, F.lit(18), F.lit(30)
    )
    return T.table(spark, sf, "events").select("event_id", num("power", 4, gated))


def normalize_technology(spark: SparkSession, sf: str) -> DataFrame:
    spellings = F.array(*[F.lit(s) for s in [*TECHNOLOGY_CODES, "unknown"]])
    place = (F.col("p_partkey") % (len(TECHNOLOGY_CODES) + 1) + 1).cast("int")
    modules = T.table(spark, sf, "part").select(
        "p_partkey", F.element_at(spellings, place).alias("technology")
    )
    return array_power.normalize_technology(modules)


def check_pressure(spark: SparkSession, sf: str) -> DataFrame:
    readings = T.station_readings(spark, sf).withColumn("pressure", F.col("pressure") * 3)
    return quality.check_pressure(readings).select("plant_id", "task", "n_bad")


def check_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    places = T.metered_plants(spark, sf)
    return quality.check_coordinates(places).select("plant_id", "task", "n_bad")


def check_nulls(spark: SparkSession, sf: str) -> DataFrame:
    readings = T.station_readings(spark, sf)
    holed = readings.withColumn("wind", F.when(F.col("wind") <= 100, F.col("wind")))
    return quality.check_nulls(holed, ["wind", "ta"]).select("plant_id", "task", "n_bad")


def check_inverter_fit(spark: SparkSession, sf: str) -> DataFrame:
    fitted = _fit(spark, sf)
    return quality.check_inverter_fit(fitted).select("plant_id", "task", "n_bad")


def terrain_constants(spark: SparkSession, sf: str) -> DataFrame:
    plants = layout.terrain_constants(T.metered_plants(spark, sf))
    return plants.select("plant_id", "z01", "z02", "cre")


def air_density(spark: SparkSession, sf: str) -> DataFrame:
    return _air(spark, sf).select("series_id", stamp(), num("rho", 8))


def geo_distance(spark: SparkSession, sf: str) -> DataFrame:
    pcc = T.wind_plants(spark, sf).select("plant_id", "pcc_lat", "pcc_lon", "pcc_elev")
    here = (F.col("lat"), F.col("lon"))
    there = (F.col("pcc_lat"), F.col("pcc_lon"))
    flat = geo.great_circle_km(*here, *there)
    full = geo.distance_km(*here, F.col("elev"), *there, F.col("pcc_elev"))
    return T.turbines(spark, sf).join(pcc, "plant_id").select(
        "turbine_id", num("flat_km", 6, flat), num("dist_km", 6, full)
    )


# --- joins -----------------------------------------------------------------------------


def align_series(spark: SparkSession, sf: str) -> DataFrame:
    inputs = T.solar_inputs(spark, sf)
    site = inputs.plants.select("plant_id", "lat", "lon", "tz")
    placed = cleaning.add_utc(inputs.series.join(site, "plant_id"))
    position = irradiance.sun_position(placed).select("plant_id", "ts", "zenith")
    outside = inputs.series.select(
        "plant_id", "ts", irradiance.extraterrestrial(F.col("ts")).alias("iext")
    )
    ground = inputs.series.select("plant_id", "ts", "ghi")
    return cleaning.align(["plant_id", "ts"], position, outside, ground).select(
        "plant_id", stamp(), num("zenith"), num("iext", 6), num("ghi", 6)
    )


def restore_index(spark: SparkSession, sf: str) -> DataFrame:
    hours = _irradiance(spark, sf)
    lit = cleaning.drop_dark(cleaning.daylight(hours))
    spine = hours.select("plant_id", "ts", "ta")
    return cleaning.restore_index(spine, lit, ["plant_id", "ts"], ["dhi"]).select(
        "plant_id", stamp(), num("ta"), num("dhi", 6)
    )


def nearest_tower(spark: SparkSession, sf: str) -> DataFrame:
    return layout.nearest_tower(T.turbines(spark, sf), T.towers(spark, sf))


def turbine_features(spark: SparkSession, sf: str) -> DataFrame:
    features = layout.turbine_features(T.turbines(spark, sf), T.models(spark))
    return features.select("turbine_id", "model_id", "hub", "radius", num("area", 6))


def fanout_series(spark: SparkSession, sf: str) -> DataFrame:
    return _hours(spark, sf).select(
        "plant_id", "turbine_id", stamp(), num("wind", 8), num("direction", 6)
    )


def pair_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return layout.local_offsets(T.turbines(spark, sf)).select(
        "plant_id", "turbine_id", num("x_m"), num("y_m"), num("dz_m")
    )


def curve_lookup(spark: SparkSession, sf: str) -> DataFrame:
    armed = _armed(spark, sf).select("plant_id", "turbine_id", "series_id", "curve")
    hours = layout.fan_out_series(armed, _air(spark, sf))
    found = curves.curve_value(hours, "p", "wind", "curve_power", _steps(spark, sf))
    return found.select("plant_id", "turbine_id", stamp(), num("curve_power"))


def series_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """One row per farm and hour with all turbines' speeds in mm/s, by turbine id."""
    text = F.transform("cells", lambda c: F.bround(c["value"] * 1000, 0).cast("bigint").cast("string"))
    rows = layout.series_matrix(_hours(spark, sf), "wind")
    return rows.select("plant_id", stamp(), F.array_join(text, ",").alias("row"))


def matrix_to_long(spark: SparkSession, sf: str) -> DataFrame:
    matrix = layout.series_matrix(_hours(spark, sf), "wind")
    return layout.matrix_to_long(matrix, "wind").select("plant_id", "turbine_id", stamp(), num("wind", 8))


def apply_corrections(spark: SparkSession, sf: str) -> DataFrame:
    turbines = _turbines(spark, sf)
    hours = _hours(spark, sf).filter("offshore")
    corrected = farm_correction.large_farm_correction(
        _behind(spark, sf).filter("offshore"), layout.mean_hub_height(turbines)
    )
    return farm_correction.apply_corrections(hours, corrected).select(
        "plant_id", "turbine_id", stamp(), num("wind", 8)
    )


# --- aggregations ----------------------------------------------------------------------


def hourly_energy_solar(spark: SparkSession, sf: str) -> DataFrame:
    return energy.hourly_energy_solar(_ac(spark, sf)).select("plant_id", stamp(), num("kwh", 2))


def hourly_energy_wind(spark: SparkSession, sf: str) -> DataFrame:
    hourly = energy.hourly_energy_wind(_power(spark, sf), T.wind_plants(spark, sf))
    return hourly.select("plant_id", stamp(), num("kwh"))


def monthly_energy(spark: SparkSession, sf: str) -> DataFrame:
    return _monthly(spark, sf).select("plant_id", *_ym(), num("monthly", 2))


def daily_equivalent(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select("plant_id", *_ym(), num("daily", 2))


def firm_energy_solar(spark: SparkSession, sf: str) -> DataFrame:
    return _firm(spark, sf).select("plant_id", *_ym(), num("firm"))


def firm_energy_wind(spark: SparkSession, sf: str) -> DataFrame:
    firm = energy.firm_energy_wind(_daily(spark, sf), T.metered_plants(spark, sf))
    return firm.select("plant_id", *_ym(), num("firm"))


def daily_surplus(spark: SparkSession, sf: str) -> DataFrame:
    return _surplus(spark, sf).select("plant_id", *_ym(), num("surplus", 2))


def mean_density(spark: SparkSession, sf: str) -> DataFrame:
    return curves.mean_density(_air(spark, sf))


def mean_resistance(spark: SparkSession, sf: str) -> DataFrame:
    means = layout.mean_resistance(T.strings(spark, sf))
    return means.select("plant_id", num("mean_ohm", 6))


def mean_hub_height(spark: SparkSession, sf: str) -> DataFrame:
    features = layout.turbine_features(T.turbines(spark, sf), T.models(spark))
    return layout.mean_hub_height(features).select("plant_id", num("mean_hub", 6))


def mean_direction(spark: SparkSession, sf: str) -> DataFrame:
    means = layout.mean_direction(_turbines(spark, sf), _air(spark, sf))
    return means.select("plant_id", stamp(), num("mean_dir", 6))


def design_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Every turbine with a curve of its own."""
    own = T.turbines(spark, sf).select("turbine_id", "model_id").join(T.points(spark), "model_id")
    factor = 1 + F.col("turbine_id") % 7 * F.col("idx") * 0.002
    own = own.select(F.col("turbine_id").alias("model_id"), "idx", "v", (F.col("p") * factor).alias("p"))
    return curves.design_speed(own).withColumnRenamed("model_id", "turbine_id")


def distinct_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return T.station_readings(spark, sf).select("plant_id", stamp()).distinct()


def inverter_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(spark, sf).select(
        "inverter_id",
        num("c0_e12", 4, F.col("c0") * 1e12),
        num("c1_e6", 4, F.col("c1") * 1e6),
        num("c2_e6", 3, F.col("c2") * 1e6),
        num("c3_e3", 4, F.col("c3") * 1e3),
    )


# --- ranking, windows, output shapes ---------------------------------------------------


def _factors(spark: SparkSession, sf: str) -> DataFrame:
    turbines = _turbines(spark, sf)
    return layout.upwind_factor(turbines, layout.mean_direction(turbines, _air(spark, sf)))


def upwind_rank(spark: SparkSession, sf: str) -> DataFrame:
    return layout.upwind_rank(_factors(spark, sf)).select(
        "plant_id", "turbine_id", stamp(), num("factor"), "rank"
    )


def lead_turbine(spark: SparkSession, sf: str) -> DataFrame:
    return layout.lead_turbine(_factors(spark, sf)).select("plant_id", stamp(), "lead_id")


def _hops(spark: SparkSession, sf: str) -> DataFrame:
    inputs = T.wind_inputs(spark, sf)
    return layout.cable_hops(inputs.links, inputs.turbines, inputs.plants)


def cable_hops(spark: SparkSession, sf: str) -> DataFrame:
    return _hops(spark, sf).select(
        "plant_id", "string_pos", "pos", "turbine_id", "next_hop", num("hop_km", 6)
    )


def cable_path(spark: SparkSession, sf: str) -> DataFrame:
    return layout.cable_path(_hops(spark, sf))


def out_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return energy.out_hourly(T.metered_energy(spark, sf))


def out_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return energy.out_monthly(_monthly(spark, sf))


def out_daily(spark: SparkSession, sf: str) -> DataFrame:
    return energy.out_daily(_daily(spark, sf))


def out_firm(spark: SparkSession, sf: str) -> DataFrame:
    return energy.out_firm(_firm(spark, sf))


def out_surplus(spark: SparkSession, sf: str) -> DataFrame:
    return energy.out_surplus(_surplus(spark, sf))


def month_list(spark: SparkSession, sf: str) -> DataFrame:
    return energy.month_list(_firm(spark, sf)).select("plant_id", *_ym(), "value")


def union_series(spark: SparkSession, sf: str) -> DataFrame:
    weather = T.weather(spark, sf).select("series_id", "ts", "wind")
    masts = T.towers(spark, sf).select("series_id", F.col("tower_id").alias("source"))
    sites = T.wind_plants(spark, sf).select("series_id", (-1 - F.col("plant_id")).alias("source"))
    both = masts.unionByName(sites).join(weather, "series_id")
    return both.select("source", stamp(), num("wind", 8))


# --- wind ------------------------------------------------------------------------------


def correct_curves(spark: SparkSession, sf: str) -> DataFrame:
    inputs = T.wind_inputs(spark, sf)
    in_use = _turbines(spark, sf).select("model_id", "rho_mean").distinct()
    return curves.correct_curves(inputs.points, inputs.models, in_use).select(
        "model_id", "rho_mean", "idx", "v_design", num("vp", 8), num("vcth", 8)
    )


def downwind_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _behind(spark, sf).select(
        "plant_id", "turbine_id", stamp(), "lead_id", num("x_dist")
    )


def ibl_height(spark: SparkSession, sf: str) -> DataFrame:
    return farm_correction.layer_height(_behind(spark, sf)).select(
        "plant_id", "turbine_id", stamp(), num("ibl")
    )


def large_farm_correction(spark: SparkSession, sf: str) -> DataFrame:
    corrected = farm_correction.large_farm_correction(
        _behind(spark, sf).filter("offshore"), layout.mean_hub_height(_turbines(spark, sf))
    )
    return corrected.select("plant_id", "turbine_id", stamp(), num("corrected", 8))


def wake_speeds(spark: SparkSession, sf: str) -> DataFrame:
    slowed = wake.wake_speeds(_thrust(spark, sf), _tiles(spark, sf))
    return slowed.select("plant_id", "turbine_id", stamp(), num("wake_speed", 8))


def cable_loss(spark: SparkSession, sf: str) -> DataFrame:
    left = turbine_power.after_cable(
        F.col("p_nom"), F.col("kv"), F.col("mean_ohm"), F.col("path_km")
    )
    return _turbines(spark, sf).select("turbine_id", num("power", 4, left))


def connection_loss_wind(spark: SparkSession, sf: str) -> DataFrame:
    left = turbine_power.after_connection(F.col("p_nom"), F.col("kpc"), F.col("kt"), F.col("kin"))
    return _turbines(spark, sf).select("turbine_id", num("power", 4, left))


def turbine_power_query(spark: SparkSession, sf: str) -> DataFrame:
    return _power(spark, sf).select("plant_id", "turbine_id", stamp(), num("power"))


def _plant_result(hourly: DataFrame, plants: DataFrame, firm_of: Callable) -> DataFrame:
    stored = sinks.stage(hourly)
    daily = energy.daily_equivalent(energy.monthly_energy(stored))
    firm = firm_of(daily, plants)
    reported = energy.out_firm(firm).select("plant_id", "firm_kwh_day")
    monthly = daily.select("plant_id", "month", "monthly")
    return (
        energy.daily_surplus(daily, firm)
        .join(monthly, ["plant_id", "month"], "left")
        .join(reported, "plant_id")
        .select("plant_id", *_ym(), "firm_kwh_day", num("surplus", 2), num("monthly", 2))
    )


def wind_plant_query(spark: SparkSession, sf: str) -> DataFrame:
    inputs = T.wind_inputs(spark, sf)
    return _plant_result(wind_plant.hourly_energy(inputs), inputs.plants, energy.firm_energy_wind)


def wind_request_result(spark: SparkSession, sf: str) -> DataFrame:
    """Firm energy of the farms as their request messages describe them."""
    series = T.wind_inputs(spark, sf).series.withColumn("series_id", T.series_file(F.col("series_id")))
    inputs = wind_plant.from_requests(T.wind_requests(spark, sf), series)
    return _plant_result(wind_plant.hourly_energy(inputs), inputs.plants, energy.firm_energy_wind)


def _failures(status: DataFrame) -> DataFrame:
    found = status.groupBy("plant_id", "task").agg(F.sum("n_bad").alias("n_bad"))
    return found.filter("n_bad > 0")


def wind_plant_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every failed check of farms with faults, from one run of the plan."""
    return _failures(wind_plant.checked_energy(T.faulty_wind_inputs(spark, sf)).status)


# --- solar -----------------------------------------------------------------------------


def _sun(spark: SparkSession, sf: str, *columns: Column) -> DataFrame:
    return _irradiance(spark, sf).select("plant_id", stamp(), *columns)


def sun_position(spark: SparkSession, sf: str) -> DataFrame:
    inputs = T.solar_inputs(spark, sf)
    site = inputs.plants.select("plant_id", "lat", "lon", "tz")
    placed = cleaning.add_utc(inputs.series.join(site, "plant_id"))
    return irradiance.sun_position(placed).select(
        "plant_id", stamp(), num("zenith"), num("azimuth")
    )


def extraterrestrial(spark: SparkSession, sf: str) -> DataFrame:
    value = irradiance.extraterrestrial(F.col("ts"))
    return T.table(spark, sf, "events").select("event_id", num("iext", 4, value))


def dni_disc(spark: SparkSession, sf: str) -> DataFrame:
    placed = _irradiance(spark, sf).select("plant_id", "ts", "ghi", "zenith")
    return irradiance.beam_disc(placed).select(
        "plant_id", stamp(), num("dni", 6), num("kt", 6), num("airmass", 6)
    )


def dhi_closure(spark: SparkSession, sf: str) -> DataFrame:
    placed = _irradiance(spark, sf).select("plant_id", "ts", "ghi", "zenith")
    closed = irradiance.diffuse_closure(irradiance.beam_disc(placed))
    return closed.select("plant_id", stamp(), num("dni", 6), num("dhi", 6))


def _array(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select("inverter_id", "array_id", stamp(), *columns)


def surface_orientation(spark: SparkSession, sf: str) -> DataFrame:
    facing = F.cos(F.radians("surface_az"))
    return _array(_plane(spark, sf), num("tilt"), num("facing_north", 6, facing))


def poa_perez(spark: SparkSession, sf: str) -> DataFrame:
    parts = {"beam": "poa_beam", "sky": "poa_sky", "ground": "poa_ground"}
    return _array(_plane(spark, sf), *[num(k, 3, v) for k, v in parts.items()])


def poa_bifacial(spark: SparkSession, sf: str) -> DataFrame:
    return _array(_plane(spark, sf), num("poa", 3))


def panel_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return _array(array_power.panel_temperature(_plane(spark, sf)), num("temp"))


def circuit_params(spark: SparkSession, sf: str) -> DataFrame:
    return _array(
        _circuit(spark, sf), num("il", 6), num("i0_e12", 4, F.col("i0") * 1e12), num("a", 6)
    )


def max_power_point(spark: SparkSession, sf: str) -> DataFrame:
    names = ("i_sc", "v_oc", "i_mp", "v_mp", "p_mp", "i_x", "i_xx")
    return _array(array_power.max_power_point(_circuit(spark, sf)), *[num(n) for n in names])


def string_scaling(spark: SparkSession, sf: str) -> DataFrame:
    scaled = array_power.string_scaling(array_power.max_power_point(_circuit(spark, sf)))
    return _array(scaled, num("v_mp", 3), num("i_mp", 3), num("p_mp", 2))


def dc_losses(spark: SparkSession, sf: str) -> DataFrame:
    scaled = array_power.string_scaling(array_power.max_power_point(_circuit(spark, sf)))
    return _array(array_power.dc_losses(scaled), num("v_mp", 3), num("i_mp", 3), num("p_mp", 2))


def inverter_ac(spark: SparkSession, sf: str) -> DataFrame:
    return _ac(spark, sf).select("inverter_id", stamp(), num("p_ac", 2))


def plant_losses_solar(spark: SparkSession, sf: str) -> DataFrame:
    hourly = energy.hourly_energy_solar(_ac(spark, sf))
    plants = T.solar_plants(spark, sf)
    return inverter.plant_losses(hourly, plants).select("plant_id", stamp(), num("kwh"))


def solar_plant_query(spark: SparkSession, sf: str) -> DataFrame:
    inputs = T.solar_inputs(spark, sf)
    return _plant_result(
        solar_plant.hourly_energy(inputs), inputs.plants, energy.firm_energy_solar
    )


def solar_plant_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every failed check of solar plants with faults, from one run of the plan."""
    return _failures(solar_plant.checked_energy(T.faulty_solar_inputs(spark, sf)).status)


def solar_request_result(spark: SparkSession, sf: str) -> DataFrame:
    """Firm energy of the solar plants as their request messages describe them."""
    series = T.weather(spark, sf).select(
        T.series_file(F.col("series_id")).alias("series_id"), "ts", "ghi", "ta", (F.col("ghi") * 0.15).alias("back_irradiance")
    )
    inputs = solar_plant.from_requests(T.solar_requests(spark, sf), series, T.module_names(spark, sf))
    return _plant_result(solar_plant.hourly_energy(inputs), inputs.plants, energy.firm_energy_solar)


# --- streaming -------------------------------------------------------------------------


def ingest_requests_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = sinks.shared_folder(spark)
    T.plain_requests(spark, sf).write.json(f"{base}/incoming")
    ingest_requests(spark, f"{base}/incoming", f"{base}/checkpoint", append_to(f"{base}/routed"))
    return spark.read.schema(f"{T.REQUEST_SCHEMA}, batch int, route string").parquet(
        f"{base}/routed"
    ).select("plant_id", "TipoMensaje", "CuerpoMensaje", "route")


def stream_to_dims(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of both kinds and unreadable ones, parsed by the stream into dimension tables."""
    base = sinks.shared_folder(spark)
    for sent in (T.wind_requests(spark, sf), T.solar_requests(spark, sf), T.plain_requests(spark, sf)):
        sent.write.mode("append").json(f"{base}/incoming")
    ingest_requests(spark, f"{base}/incoming", f"{base}/checkpoint", fan_out_to(f"{base}/tables"))
    solar = dimensions_of(spark, f"{base}/tables", "solar")
    place = lambda *names: F.concat_ws(":", *names)
    letters = dead_letters(spark, f"{base}/tables").groupBy("plant_id", "message").agg(F.count("*").alias("n"))
    return (
        _wind_dims(dimensions_of(spark, f"{base}/tables", "wind"))
        .unionByName(_dim_rows(solar["plants"], "solar plant", F.col("tz"), "cen"))
        .unionByName(_dim_rows(solar["inverters"], "inverter", F.col("inverter_id"), "paco"))
        .unionByName(_dim_rows(solar["modules"], "module", place("inverter_id", "module_model"), "t_noct"))
        .unionByName(_dim_rows(solar["arrays"], "array", place("inverter_id", "array_id"), "axis_az"))
        .unionByName(_dim_rows(letters, "dead letter", F.col("message"), "n"))
    )


_QUERIES: list[Query] = [
    scan_series, scan_towers, series_files, config_to_dims, dispatch_by_type, write_result_tables,
    result_payload, failure_payload, request_status, accepted_plants, matrix_to_long, write_csv, plant_status, parse_decimal_comma, build_timestamp, scale_ghi,
    daylight_filter, drop_dark_rows, low_sun_clamp, cap_interconnection, floor_zero,
    temperature_gate, normalize_technology, check_pressure, check_coordinates, check_nulls,
    check_inverter_fit, terrain_constants, air_density, geo_distance, align_series,
    restore_index, nearest_tower, turbine_features, fanout_series, pair_offsets, curve_lookup,
    series_matrix, apply_corrections, hourly_energy_solar, hourly_energy_wind, monthly_energy,
    daily_equivalent, firm_energy_solar, firm_energy_wind, daily_surplus, mean_density,
    mean_resistance, mean_hub_height, mean_direction, design_speed, distinct_timestamps,
    inverter_fit, upwind_rank, lead_turbine, cable_hops, cable_path, out_hourly, out_monthly,
    out_daily, out_firm, out_surplus, month_list, union_series, correct_curves,
    downwind_distance, ibl_height, large_farm_correction, wake_speeds, cable_loss,
    connection_loss_wind, turbine_power_query, wind_plant_query,
    wind_request_result, wind_plant_status, solar_plant_status, solar_request_result, sun_position,
    extraterrestrial, dni_disc, dhi_closure, surface_orientation, poa_perez, poa_bifacial,
    panel_temperature, circuit_params, max_power_point, string_scaling, dc_losses, inverter_ac,
    plant_losses_solar, solar_plant_query, ingest_requests_stream, stream_to_dims,
]


def _tuned(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {q.__name__.removesuffix("_query"): _tuned(q) for q in _QUERIES}

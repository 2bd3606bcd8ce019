"""Domain tables derived from the driver tables.

Every mapping is a pure expression on a whole table, so the domain grows with the
input: suppliers become turbines, inverters and plants, events the weather,
line items the metered energy, parts the modules.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmwatt import schemas
from firmwatt.operators.cleaning import clean_wind
from firmwatt.plans.solar_plant import SolarInputs
from firmwatt.plans.wind_plant import WindInputs

FARM_SIZE = 20
STATIONS = 5

# Power (kW) and thrust of the test turbine at 1..25 m/s.
CURVE_POWER = [
    0.0, 3.6, 29.9, 98.2, 208.3, 384.3, 637.0, 975.8, 1403.6, 1817.8, 2088.7, 2237.0, 2300.0,
    2350.0, 2350.0, 2350.0, 2350.0, 2350.0, 2350.0, 2350.0, 2350.0, 2350.0, 2350.0, 2350.0, 2350.0,
]
CURVE_THRUST = [
    0.0, 1.0, 0.95, 0.88, 0.87, 0.87, 0.87, 0.83, 0.77, 0.71, 0.67, 0.5, 0.37, 0.29, 0.23, 0.19,
    0.16, 0.13, 0.11, 0.1, 0.09, 0.08, 0.07, 0.06, 0.06,
]
# model_id, hub, rotor_d, p_nom, v_nom, rho_nom, v_min, v_max, t_min, t_max,
# power scale. The second model is a scaled copy.
MODELS = [
    ("M0", 98.0, 92.0, 2350.0, 14.0, 1.23, 2.0, 25.0, -10.0, 45.0, 1.0),
    ("M1", 110.0, 104.0, 2820.0, 14.0, 1.2, 2.0, 25.0, -10.0, 25.5, 1.2),
]
# Measured DC and AC power (W) of the test inverter, seven points each
# at the lowest, nominal and highest voltage.
INVERTER_DC = [
    87520.0, 172720.0, 343090.0, 513280.0, 854520.0, 1282560.0, 1712680.0,
    88160.0, 173310.0, 343860.0, 515790.0, 856510.0, 1285160.0, 1715980.0,
    89060.0, 174070.0, 344670.0, 515210.0, 857730.0, 1286600.0, 1716860.0,
]
INVERTER_AC = [
    84439.3, 168868.3, 337737.8, 506607.4, 844351.2, 1266528.0, 1688702.5,
    84439.6, 168873.3, 337739.3, 508001.6, 844347.6, 1266525.2, 1688695.9,
    84437.8, 168865.3, 337742.1, 506606.0, 844349.4, 1266529.0, 1688703.5,
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- plants with a long metered series -------------------------------------------------


def metered_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS plant_id",
        "CAST(s_suppkey % 2 AS INT) AS kind",
        "0.2D + 0.1D * (s_nationkey % 5) AS cen",
        "10.0D + s_nationkey AS ihf",
        "s_nationkey % 2 = 0 AS measured",
        "s_nationkey % 3 = 0 AS offshore",
        "20000.0D + 1000.0D * s_nationkey AS ppi_kwh",
        "1000.0D * (20000.0D + 1000.0D * s_nationkey) AS ppi",
        "s_acctbal / 100 AS lat",
        "s_acctbal / 50 AS lon",
    )


def metered_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS plant_id", "l_shipdate AS ts", "l_quantity * 1000 AS kwh"
    )


# --- weather ---------------------------------------------------------------------------


def raw_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw reading per event, as calendar parts and decimal-comma text."""
    events = (
        spark.read.schema("event_id bigint, ts timestamp_ntz, user_id bigint, value double")
        .parquet(f"{sf_dir}/events.parquet")
    )
    return events.selectExpr(
        "event_id",
        f"user_id % {STATIONS} AS series_id",
        "CAST(year(ts) AS STRING) AS Ano",
        "CAST(month(ts) AS STRING) AS Mes",
        "CAST(day(ts) AS STRING) AS Dia",
        "CAST(hour(ts) AS STRING) AS Hora",
        "replace(CAST(event_id * 37 % 360 + 0.25D AS STRING), '.', ',') AS DireccionViento",
        "replace(CAST(990.5D + event_id % 25 AS STRING), '.', ',') AS PresionAtmosferica",
        "replace(CAST(15.5D + user_id % 20 AS STRING), '.', ',') AS Ta",
        "replace(CAST(value AS STRING), '.', ',') AS VelocidadViento",
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather per station; ``ghi`` in Wh/m2."""
    hourly = (
        table(spark, sf_dir, "events")
        .selectExpr(
            "make_timestamp_ntz(year(ts), month(ts), day(ts), hour(ts), 0, 0) AS ts",
            "event_id", "user_id", "value",
        )
        .groupBy("ts")
        .agg(
            F.expr("bround(avg(sqrt(value)) * (0.6D + 0.05D * hour(ts)), 6)").alias("wind"),
            F.expr("sum(event_id * 37) % 360 + 0.37D").alias("direction"),
            F.expr("bround(avg(15 + user_id % 20), 6)").alias("ta"),
            F.expr("bround(avg(990 + event_id % 25), 6)").alias("pressure"),
            F.expr(
                "bround(avg(value) / 60 * greatest(0.0D, "
                "1 - (hour(ts) - 12.0D) * (hour(ts) - 12.0D) / 42.25D), 6)"
            ).alias("ghi_kwh"),
        )
    )
    stations = hourly.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(STATIONS - 1))))
    # The hourly table is tiny and each of its rows drives many turbines and arrays, so
    # it is spread over all cores before it fans out.
    spread = stations.repartition(spark.sparkContext.defaultParallelism, "s", "ts")
    return spread.selectExpr(
        "CAST(s AS BIGINT) AS series_id",
        "ts",
        "wind * (0.9D + 0.05D * s) AS wind",
        "direction + 4 * s AS direction",
        "ta + 0.25D * s AS ta",
        "pressure + 0.5D * s AS pressure",
        "ghi_kwh * (0.8D + 0.05D * s) * 1000 AS ghi",
    )


# --- wind farms ------------------------------------------------------------------------


def turbines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .selectExpr(
            "s_suppkey AS turbine_id", f"s_suppkey div {FARM_SIZE} AS plant_id",
            f"s_suppkey % {FARM_SIZE} AS k",
        )
        .selectExpr(
            "plant_id",
            "turbine_id",
            "k AS ordinal",
            "CASE WHEN k % 2 = 0 THEN 'M0' ELSE 'M1' END AS model_id",
            "12.24D + 0.2D * (plant_id % 50) + 0.005D * (k % 5)"
            " + 0.00001D * (turbine_id * 7919 % 97) AS lat",
            "-71.23D + 0.0126D * (k div 5) + 0.00001D * (turbine_id * 104729 % 89) AS lon",
            "30.0D + 2.0D * (k % 4) AS elev",
            "plant_id * 3 + k % 3 AS declared_tower",
            "k div 5 AS string_pos",
            "k % 5 AS pos",
        )
    )


def wind_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    farms = turbines(spark, sf_dir).select("plant_id").distinct()
    return farms.selectExpr(
        "plant_id",
        "concat('farm ', plant_id) AS name",
        "2.0D + plant_id % 10 AS cen",
        "5.0D + 3 * (plant_id % 7) AS ihf",
        "12000000.0D + 1000000.0D * (plant_id % 9) AS ppi",
        "0.2D AS kpc", "0.5D AS kt", "0.1D AS kin", "36.0D AS kv",
        "plant_id % 2 = 0 AS measured",
        "plant_id % 3 = 0 AS offshore",
        "12.23987D + 0.2D * (plant_id % 50) AS pcc_lat",
        "-71.25036D AS pcc_lon",
        "32.0D AS pcc_elev",
        f"plant_id % {STATIONS} AS series_id",
    )


def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    farms = turbines(spark, sf_dir).select("plant_id").distinct()
    return farms.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(
        "plant_id",
        "plant_id * 3 + t AS tower_id",
        "12.24D + 0.2D * (plant_id % 50) + 0.01D * t AS lat",
        "-71.23D + 0.0126D * t AS lon",
        "30.0D + t AS elev",
        "1.2D + 0.4D * t AS radius_km",
        f"(plant_id + t) % {STATIONS} AS series_id",
    )


def models(spark: SparkSession) -> DataFrame:
    names = (
        "model_id", "hub", "rotor_d", "p_nom", "v_nom", "rho_nom", "v_min", "v_max", "t_min",
        "t_max", "scale",
    )
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, m)]) for m in MODELS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def points(spark: SparkSession) -> DataFrame:
    lists = F.array(
        *[
            F.struct(F.lit(i + 1.0).alias("v"), F.lit(p).alias("p"), F.lit(c).alias("ct"))
            for i, (p, c) in enumerate(zip(CURVE_POWER, CURVE_THRUST))
        ]
    )
    return models(spark).select(
        "model_id", "scale", F.posexplode(lists).alias("idx", "x")
    ).selectExpr("model_id", "idx", "x.v AS v", "x.p * scale AS p", "x.ct AS ct")


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        turbines(spark, sf_dir).select("plant_id", "string_pos").distinct()
        .selectExpr("plant_id", "string_pos", "0.2D + 0.01D * string_pos AS ohm")
    )


def wind_inputs(spark: SparkSession, sf_dir: str) -> WindInputs:
    t = turbines(spark, sf_dir)
    return WindInputs(
        plants=wind_plants(spark, sf_dir),
        turbines=t.drop("string_pos", "pos"),
        towers=towers(spark, sf_dir),
        models=models(spark).drop("scale", "v_min"),
        points=points(spark),
        strings=strings(spark, sf_dir),
        links=t.select("plant_id", "string_pos", "pos", "turbine_id"),
        series=weather(spark, sf_dir).select(
            "series_id", "ts", "wind", "direction", "ta", "pressure"
        ),
    )


# --- solar plants ----------------------------------------------------------------------


def inverters(spark: SparkSession, sf_dir: str) -> DataFrame:
    dc = F.array(*[F.lit(v) for v in INVERTER_DC])
    ac = F.array(*[F.lit(v) for v in INVERTER_AC])
    base = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS inverter_id", "s_suppkey div 4 AS plant_id", "s_nationkey",
        "0.5D + 0.125D * (s_suppkey % 8) AS scale",
    )
    return base.select(
        "plant_id", "inverter_id", "scale",
        F.expr("1 + s_nationkey % 3").alias("n_inv"),
        F.expr("200000.0D * scale").alias("paco"),
        F.expr("202507.04D * scale").alias("pdco"),
        F.lit(1174.0).alias("vdco"),
        F.expr("2025.07D * scale").alias("pso"),
        F.lit(3.3).alias("pnt"),
        F.transform(dc, lambda x: x * F.col("scale")).alias("p_dc_points"),
        F.transform(ac, lambda x: x * F.col("scale")).alias("p_ac_points"),
    )


def solar_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = inverters(spark, sf_dir).select("plant_id").distinct()
    return sites.selectExpr(
        "plant_id",
        "4.6454D + 0.05D * (plant_id % 60) AS lat",
        "-74.06604D + 0.02D * (plant_id % 40) AS lon",
        "'America/Bogota' AS tz",
        "0.17D + 0.01D * (plant_id % 5) AS albedo",
        "14.6D AS l_pct",
        "0.2D + 0.1D * (plant_id % 4) AS cen",
        "5.0D + plant_id % 20 AS ihf",
        "500000.0D + 10000.0D * (plant_id % 30) AS ppi",
        "0.5D AS kpc", "0.25D AS kt", "0.125D AS kin",
        "plant_id % 2 = 0 AS measured",
        f"plant_id % {STATIONS} AS series_id",
    )


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inverters(spark, sf_dir)
        .select("plant_id", "inverter_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("array_id"))
        .selectExpr(
            "plant_id", "inverter_id", "array_id",
            "inverter_id % 2 = 0 AS tracker",
            "108.0D + 10 * array_id + inverter_id % 7 AS axis_az",
            "4.0D + 3 * array_id AS axis_tilt",
            "55.0D AS max_angle",
            "26 - array_id AS modules_per_string",
            "17 + CAST(inverter_id % 3 AS INT) AS strings",
        )
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverters(spark, sf_dir).selectExpr(
        "plant_id",
        "inverter_id",
        "45.0D AS t_noct", "10.0D AS psi",
        "inverter_id % 3 = 0 AS bifacial", "0.7D AS bifaciality",
        "0.05D AS alpha_sc",
        "1.85D AS a_ref",
        "14.25D + 0.01D * (inverter_id % 10) AS il_ref",
        "2.2e-11D AS i0_ref", "0.22D AS rs_ref", "400.0D AS rsh_ref", "6.0D AS adjust",
    )


def solar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = solar_plants(spark, sf_dir).select("plant_id", "series_id")
    return weather(spark, sf_dir).join(sites, "series_id").select(
        "plant_id", "ts", "ghi", "ta", (F.col("ghi") * 0.15).alias("back_irradiance")
    )


def solar_inputs(spark: SparkSession, sf_dir: str) -> SolarInputs:
    return SolarInputs(
        plants=solar_plants(spark, sf_dir).drop("series_id"),
        inverters=inverters(spark, sf_dir).drop("scale"),
        arrays=arrays(spark, sf_dir),
        modules=modules(spark, sf_dir),
        series=solar_series(spark, sf_dir),
    )


def faulty_wind_inputs(spark: SparkSession, sf_dir: str) -> WindInputs:
    """The wind farms with faults by farm number modulo 6, and two in the weather of station 2.

    1: a turbine off the globe, one without elevation, one of an unknown model. 2: a turbine
    without a cable, one with an unknown tower. 3: no cable strings, no voltage. 4: a model
    whose top speed leaves too few points. 5: a model with an infinite thrust coefficient.
    """
    good = wind_inputs(spark, sf_dir)
    fault, k = F.col("plant_id") % 6, F.col("ordinal")
    names = F.when((fault == 1) & (k == 4), "MX").when((fault == 4) & (k == 6), "MC").when((fault == 5) & (k == 0), "MT")
    tower = F.when((fault == 2) & (k == 4), F.lit(-1).cast("long")).otherwise(F.col("declared_tower"))
    turbines = good.turbines.withColumns(
        {
            "model_id": F.coalesce(names, "model_id"),
            "declared_tower": tower,
            "lat": F.when((fault == 1) & (k == 2), 100.0).otherwise(F.col("lat")),
            "elev": F.when((fault == 1) & (k == 3), None).otherwise(F.col("elev")),
        }
    )
    copy = lambda df, name: df.filter("model_id = 'M1'").withColumn("model_id", F.lit(name))
    flat = copy(good.models, "MC").withColumn("v_max", F.lit(2.5))
    infinite = F.when(F.col("idx") == 9, float("inf")).otherwise(F.col("ct"))
    hour, station = F.hour("ts"), F.col("series_id") == 2
    return replace(
        good,
        turbines=turbines,
        plants=good.plants.withColumn("kv", F.when(fault == 3, None).otherwise(F.col("kv"))),
        strings=good.strings.filter(fault != 3),
        links=good.links.join(good.turbines.filter((fault == 2) & (k == 3)).select("turbine_id"), "turbine_id", "left_anti"),
        models=good.models.unionByName(flat).unionByName(copy(good.models, "MT")),
        points=good.points.unionByName(copy(good.points, "MC")).unionByName(
            copy(good.points, "MT").withColumn("ct", infinite)
        ),
        series=good.series.withColumn("pressure", F.when(station & (hour == 5), 3100.0).otherwise(F.col("pressure"))).withColumn(
            "ta", F.when(station & (hour == 7), None).otherwise(F.col("ta"))
        ),
    )


def faulty_solar_inputs(spark: SparkSession, sf_dir: str) -> SolarInputs:
    """The solar plants with one fault each by plant number modulo 8, 0 without any.

    1: off the globe. 2: an inverter without its module. 3: a module without a circuit
    parameter. 4: an inverter without arrays. 5: an inverter without measured points. 6: every
    hour twice. 7: hours without irradiance.
    """
    good = solar_inputs(spark, sf_dir)
    fault, k = F.col("plant_id") % 8, F.col("inverter_id") % 4
    return replace(
        good,
        plants=good.plants.withColumn("lat", F.when(fault == 1, F.col("lat") + 100).otherwise(F.col("lat"))),
        modules=good.modules.filter(~((fault == 2) & (k == 1))).withColumn(
            "a_ref", F.when((fault == 3) & (k == 2), None).otherwise(F.col("a_ref"))
        ),
        arrays=good.arrays.filter(~((fault == 4) & (k == 3))),
        inverters=good.inverters.withColumn(
            "p_ac_points", F.when((fault == 5) & (k == 0), None).otherwise(F.col("p_ac_points"))
        ),
        series=good.series.unionByName(good.series.filter(fault == 6)).withColumn(
            "ghi", F.when((fault == 7) & (F.hour("ts") == 12), None).otherwise(F.col("ghi"))
        ),
    )


# --- requests --------------------------------------------------------------------------


def series_file(series_id: Column) -> Column:
    return F.concat(F.lit("station-"), series_id.cast("string"), F.lit(".parquet"))


def wind_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wind request per farm, as the JSON text a client would send."""
    t = turbines(spark, sf_dir)
    spots = (
        t.join(models(spark), "model_id")
        .groupBy(
            "plant_id", "model_id", "hub", "rotor_d", "p_nom", "v_nom", "rho_nom", "v_min", "v_max",
            "t_min", "t_max",
        )
        .agg(
            F.sort_array(
                F.collect_list(
                    F.expr(
                        "named_struct('Aerogenerador', turbine_id, 'Latitud', lat, 'Longitud', lon,"
                        " 'Elevacion', elev, 'MedicionAsociada',"
                        " named_struct('Value', CAST(declared_tower AS STRING)))"
                    )
                )
            ).alias("spots")
        )
    )
    curve = (
        points(spark)
        .groupBy("model_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.expr(
                        "named_struct('SerieVelocidad', v, 'SeriePotencia', p,"
                        " 'SerieCoeficiente', ct)"
                    )
                )
            ).alias("curve")
        )
    )
    groups = (
        spots.join(curve, "model_id")
        .groupBy("plant_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.expr(
                        "named_struct('ModeloAerogenerador', model_id, 'AlturaBuje', hub,"
                        " 'DiametroRotor', rotor_d, 'PotenciaNominal', p_nom,"
                        " 'VelocidadNominal', v_nom, 'DensidadNominal', rho_nom,"
                        " 'VelocidadCorteInferior', v_min, 'VelocidadCorteSuperior', v_max,"
                        " 'TemperaturaAmbienteMinima', t_min, 'TemperaturaAmbienteMaxima', t_max,"
                        " 'CurvasDelFabricante', curve,"
                        " 'EspecificacionesEspacialesAerogeneradores', spots)"
                    )
                )
            ).alias("groups")
        )
    )
    masts = (
        towers(spark, sf_dir)
        .withColumn("file", series_file(F.col("series_id")))
        .groupBy("plant_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.expr(
                        "named_struct('IdentificadorTorre', CAST(tower_id AS STRING), 'Latitud', lat,"
                        " 'Longitud', lon, 'Elevacion', elev, 'RadioRepresentatividad', radius_km,"
                        " 'ArchivoSeriesRelacionado', file)"
                    )
                )
            ).alias("masts")
        )
    )
    cables = (
        t.groupBy("plant_id", "string_pos")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.expr(
                        "named_struct('OrdenConexion', CAST(pos + 1 AS INT),"
                        " 'IdentificadorAerogenerador', turbine_id)"
                    )
                )
            ).alias("hops")
        )
        .join(strings(spark, sf_dir), ["plant_id", "string_pos"])
        .groupBy("plant_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.expr(
                        "named_struct('Conexion', CAST(string_pos + 1 AS INT), 'Resistencia', ohm,"
                        " 'ConexionAerogenerador', hops)"
                    )
                )
            ).alias("cables")
        )
    )
    body = F.expr(
        "to_json(named_struct('ParametrosTransversales', named_struct('NombrePlanta', name,"
        " 'Cen', cen, 'Ihf', ihf, 'Ppi', ppi, 'Kpc', kpc, 'Kt', kt, 'Kin', kin,"
        " 'Latitud', pcc_lat, 'Longitud', pcc_lon, 'InformacionMedida', measured,"
        " 'Offshore', offshore, 'Elevacion', pcc_elev, 'Voltaje', kv),"
        " 'ParametrosConfiguracion', named_struct('SistemasDeMedicion', masts,"
        " 'Aerogeneradores', groups, 'ParametroConexion', cables),"
        " 'ArchivoSeries', named_struct('Nombre', file)))"
    )
    return (
        wind_plants(spark, sf_dir)
        .withColumn("file", series_file(F.col("series_id")))
        .join(groups, "plant_id")
        .join(masts, "plant_id")
        .join(cables, "plant_id")
        .select("plant_id", F.lit(1).alias("TipoMensaje"), body.alias("CuerpoMensaje"))
    )


def solar_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One solar request per plant, as the JSON text a client would send."""
    panels = arrays(spark, sf_dir).groupBy("plant_id", "inverter_id", "tracker").agg(
        F.sort_array(
            F.collect_list(
                F.expr(
                    "named_struct('Id', array_id, 'CantidadSerie', modules_per_string,"
                    " 'CantidadParalero', strings, 'OAzimutal', axis_az, 'OElevacion', axis_tilt,"
                    " 'OMax', max_angle)"
                )
            )
        ).alias("panels")
    )
    group = F.expr(
        "named_struct('id', inverter_id,"
        " 'ParametrosInversor', named_struct('NInv', n_inv, 'PACnominal', paco, 'PDCnominal', pdco,"
        " 'VDCnominal', vdco, 'PDCarranque', pso, 'PACnocturnoW', pnt, 'PowerAc', p_ac_points,"
        " 'PowerDc', p_dc_points),"
        " 'ParametrosModulo', named_struct('ReferenciaModulo', module_model, 'Tnoct', t_noct,"
        " 'AlphaSc', alpha_sc, 'Psi', psi, 'Bifacial', bifacial, 'Bifacialidad', bifaciality),"
        " 'EstructuraYConfiguracion', named_struct('EstructuraPlantaConSeguidores', tracker,"
        " 'CantidadPanelConectados', panels))"
    )
    groups = (
        inverters(spark, sf_dir)
        .join(module_names(spark, sf_dir), ["plant_id", "inverter_id"])
        .join(panels, ["plant_id", "inverter_id"])
        .groupBy("plant_id")
        .agg(F.array_sort(F.collect_list(group)).alias("groups"))
    )
    body = F.expr(
        "to_json(named_struct('ParametrosTransversales', named_struct('ZonaHoraria', tz,"
        " 'Albedo', albedo, 'L', l_pct, 'Cen', cen, 'Ihf', ihf, 'Ppi', ppi, 'Kpc', kpc, 'Kt', kt,"
        " 'Kin', kin, 'Latitud', lat, 'Longitud', lon, 'InformacionMedida', measured),"
        " 'ParametrosConfiguracion', named_struct('GrupoInversores', groups),"
        " 'ArchivoSeries', named_struct('Nombre', file)))"
    )
    return (
        solar_plants(spark, sf_dir)
        .withColumn("file", series_file(F.col("series_id")))
        .join(groups, "plant_id")
        .select("plant_id", F.lit(0).alias("TipoMensaje"), body.alias("CuerpoMensaje"))
    )


def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inverter's module under a name of its own, as a request gives it."""
    return modules(spark, sf_dir).withColumn("module_model", F.concat(F.lit("module-"), F.col("inverter_id").cast("string")))


def plain_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short request per supplier; some are of a kind that does not exist."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS plant_id",
        "CAST(s_nationkey % 3 AS INT) AS TipoMensaje",
        "to_json(named_struct('ArchivoSeries', named_struct('Nombre', s_name)))"
        " AS CuerpoMensaje",
    )


def station_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned readings of every event with the plant (station) they belong to."""
    return clean_wind(raw_wind(spark, sf_dir)).withColumnRenamed("series_id", "plant_id")


REQUEST_SCHEMA = schemas.REQUEST

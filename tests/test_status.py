"""Plants with inputs that would lower their energy unseen are reported and left out."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from firmwatt.checks import tables as T
from firmwatt.checks.tables import INVERTER_AC, INVERTER_DC
from firmwatt.functions.text import local_stamp
from firmwatt.operators import inverter
from firmwatt.plans import solar_plant, wind_plant
from firmwatt.sources import requests

SF = "/root/testdata/sf0.001"


def broken(inputs):
    """Inputs with one fault each, by the check that must find it."""
    turbine = inputs.turbines.orderBy("turbine_id").first()
    other = (F.col("plant_id") != turbine["plant_id"]) | (F.col("turbine_id") != turbine["turbine_id"])
    here = F.col("plant_id") == turbine["plant_id"]
    return turbine["plant_id"], {
        "cables": replace(inputs, links=inputs.links.filter(other)),
        "links": replace(inputs, turbines=inputs.turbines.filter(other)),
        "models": replace(inputs, points=inputs.points.filter(F.col("idx") % 12 == 0)),
        "strings": replace(inputs, strings=inputs.strings.filter(~here)),
        "series": replace(inputs, series=inputs.series.limit(0)),
        "stamps": replace(inputs, series=inputs.series.union(inputs.series)),
        "values": replace(inputs, series=inputs.series.withColumn("ta", F.lit(None).cast("double"))),
    }


def test_wind_faults_are_reported_and_left_out(spark):
    inputs = T.wind_inputs(spark, SF)
    assert not wind_plant.status(inputs).filter("n_bad > 0").count()
    plant, faults = broken(inputs)
    for task, faulty in faults.items():
        bad = wind_plant.status(faulty).filter("n_bad > 0").collect()
        assert plant in {r["plant_id"] for r in bad if r["task"] == task}, task
        assert all(r["message"] for r in bad)
        kept = wind_plant.accepted_inputs(faulty)
        assert kept.plants.filter(F.col("plant_id") == plant).count() == 0
        assert kept.turbines.filter(F.col("plant_id") == plant).count() == 0


def test_requests_that_no_plan_can_take(spark):
    rows = [(1, 0, "{not json"), (2, 1, None), (3, 7, "{}"), (4, 0, '{"ParametrosConfiguracion":{"GrupoInversores":[]}}')]
    sent = spark.createDataFrame(rows, T.REQUEST_SCHEMA)
    bad = {r["plant_id"]: r["message"] for r in requests.request_status(sent).collect()}
    assert bad == {1: "request cannot be read", 2: "request cannot be read", 3: "unknown plant kind"}
    assert [r["plant_id"] for r in requests.accepted(sent, "solar").collect()] == [4]


def test_inverters_are_numbered_by_plant(spark):
    rows = [
        (1, 1, 2e5, 1174.0, INVERTER_DC, INVERTER_AC),
        (2, 1, 2e5, 1174.0, INVERTER_DC, [0.9 * p for p in INVERTER_AC]),
        (3, 1, 2e5, 1174.0, INVERTER_DC[:14], INVERTER_AC[:14]),
        (4, 1, 2e5, 1174.0, None, None),
    ]
    units = spark.createDataFrame(
        rows, "plant_id int, inverter_id int, paco double, vdco double, p_dc_points array<double>, p_ac_points array<double>"
    )
    fit = inverter.inverter_fit(inverter.inverter_samples(units))
    one, two = (fit.filter(F.col("plant_id") == p).first() for p in (1, 2))
    assert two["c0"] == pytest.approx(0.9 * one["c0"], rel=1e-6)
    inputs = solar_plant.SolarInputs(units, units, units, units, units)
    bad = {r["plant_id"] for r in solar_plant.status(inputs, fit).filter("n_bad > 0").collect()}
    assert bad == {3, 4}


def test_a_bad_date_is_null(spark):
    rows = spark.createDataFrame([(2024, 2, 30, 1), (2024, 2, 29, 1), (2024, 13, 1, 1)], "y int, m int, d int, h int")
    got = [r[0] for r in rows.select(local_stamp(*map(F.col, "ymdh"))).collect()]
    assert got[0] is None and got[2] is None and got[1].day == 29


def test_one_model_name_in_two_plants(spark):
    """Plants that give one name to different models keep their own curves."""
    requests = T.wind_requests(spark, SF)
    other = requests.select(
        (F.col("plant_id") + 1000).alias("plant_id"),
        "TipoMensaje",
        F.regexp_replace("CuerpoMensaje", '"PotenciaNominal":', '"PotenciaNominal":0.5,"Era":').alias("CuerpoMensaje"),
    )
    series = T.wind_inputs(spark, SF).series
    series = series.withColumn("series_id", T.series_file(F.col("series_id")))
    both = wind_plant.from_requests(requests.unionByName(other), series)
    alone = wind_plant.from_requests(requests, series)
    names = both.turbines.select("model_id").distinct().count()
    assert names == 2 * alone.turbines.select("model_id").distinct().count() == both.models.count()
    assert not wind_plant.status(both).filter("n_bad > 0").count()
    features = wind_plant.static_turbines(both).groupBy("plant_id").agg(F.max("p_nom").alias("p"))
    powers = {r["plant_id"]: r["p"] for r in features.collect()}
    assert all(powers[p] == 0.5 for p in powers if p >= 1000)
    assert all(powers[p] > 0.5 for p in powers if p < 1000)


def test_solar_request_feeds_the_plan(spark):
    """The module's circuit parameters and the plant's series come by name."""
    unit = {"NInv": 1, "PACnominal": 2e5, "PDCnominal": 2.1e5, "VDCnominal": 1174.0, "PDCarranque": 900.0,
            "PACnocturnoW": 10.0, "PowerAc": INVERTER_AC, "PowerDc": INVERTER_DC}
    module = {"ReferenciaModulo": "m", "Tnoct": 45, "Psi": 0.5, "Bifacial": False, "Bifacialidad": 0,
              "AlphaSc": 0.05, "Tecnologia": {"Value": "monosi"}}
    frame = {"EstructuraPlantaConSeguidores": False, "CantidadPanelConectados": [
        {"Id": 1, "CantidadSerie": 26, "CantidadParalero": 4, "OAzimutal": 180.0, "OElevacion": 10.0}]}
    body = {
        "ParametrosTransversales": {"ZonaHoraria": "America/Bogota", "Albedo": 0.2, "L": 14.6, "Cen": 11, "Ihf": 5,
                                    "Ppi": 1e9, "Kpc": 0.1, "Kt": 0.1, "Kin": 0.1, "Latitud": 4.6,
                                    "Longitud": -74.1, "InformacionMedida": True},
        "ParametrosConfiguracion": {"GrupoInversores": [
            {"ParametrosInversor": unit, "ParametrosModulo": module, "EstructuraYConfiguracion": frame}]},
        "ArchivoSeries": {"Nombre": "a.parquet"},
    }
    sent = spark.createDataFrame([(p, 0, json.dumps(body)) for p in (7, 8)], T.REQUEST_SCHEMA)
    series = spark.sql(
        "SELECT 'a.parquet' AS series_id, TIMESTAMP_NTZ '2020-03-01 12:00:00' AS ts, 900D AS ghi,"
        " 25D AS ta, 0D AS back_irradiance"
    )
    circuits = T.modules(spark, SF).limit(1).withColumn("module_model", F.lit("m"))
    inputs = solar_plant.from_requests(sent, series, circuits)
    rows = {r["plant_id"]: r["kwh"] for r in solar_plant.hourly_energy(inputs).collect()}
    assert rows.keys() == {7, 8} and rows[7] == rows[8] > 0

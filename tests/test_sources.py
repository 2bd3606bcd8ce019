"""Readers, writers, requests and the stream."""

import datetime as dt
import json
from types import SimpleNamespace

from pyspark.sql import functions as F

from firmwatt.checks import tables as T
from firmwatt.plans import solar_plant
from firmwatt.sources import requests, series, sinks
from firmwatt.streaming.requests import append_to, ingest_requests

SF = "/root/testdata/sf0.001"


def _raw(spark):
    return spark.createDataFrame(
        [("2008", "1", "1", "0", "75,25", "990,62", "28,11", "8,66"),
         ("2008", "1", "1", "23", "78,42", "990,62", "27,51", "9,73")],
        series.schemas.RAW_WIND,
    )


def test_read_series_and_towers(spark, tmp_path):
    for name in ("a", "b"):
        _raw(spark).coalesce(1).write.parquet(str(tmp_path / name))
    got = series.read_wind_series(spark, str(tmp_path / "a")).orderBy("ts").collect()
    assert got[1].ts == dt.datetime(2008, 1, 1, 23) and got[1].wind == 9.73
    names = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b")).select(
        F.col("_metadata.file_path").alias("file_path")
    ).distinct()
    files = names.select("file_path", F.hash("file_path").alias("tower_id"))
    towers = series.read_tower_series(spark, [str(tmp_path / n) for n in ("a", "b")], files)
    assert towers.count() == 4 and towers.select("tower_id").distinct().count() == 2
    # Reading leaves the input in place.
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_solar_series_in_watts(spark, tmp_path):
    df = spark.createDataFrame([("2008", "1", "1", "12", "0,5", "20,5")], series.schemas.RAW_SOLAR)
    df.write.parquet(str(tmp_path / "s"))
    got = series.read_solar_series(spark, str(tmp_path / "s")).first()
    assert (got.ghi, got.ta) == (500.0, 20.5)


def test_solar_request(spark):
    module = {"Tnoct": 45, "Psi": 10, "Tecnologia": {"Value": "monosi"}, "Bifacial": True}
    body = {
        "ParametrosTransversales": {"ZonaHoraria": "America/Bogota", "L": 14.6, "Cen": 11},
        "ParametrosConfiguracion": {"GrupoInversores": [{
            "ParametrosInversor": {"NInv": 2, "PowerAc": [1, 2], "PowerDc": [3, 4]},
            "ParametrosModulo": module,
            "EstructuraYConfiguracion": {"EstructuraPlantaConSeguidores": True,
                "CantidadPanelConectados": [{"Id": 1, "CantidadSerie": 26, "OMax": 55},
                                            {"Id": 2, "CantidadSerie": 25}]}}]},
        "Unknown": 1,
    }
    df = spark.createDataFrame([(7, 0, json.dumps(body))], T.REQUEST_SCHEMA)
    dims = requests.solar_dimensions(df)
    assert dims["plants"].first().tz == "America/Bogota"
    assert dims["modules"].first().technology == "monosi"
    assert dims["inverters"].first().p_dc_points == [3.0, 4.0]
    arrays = dims["arrays"].orderBy("array_id").collect()
    assert [(a.modules_per_string, a.max_angle) for a in arrays] == [(26, 55.0), (25, None)]


def test_wind_request_keeps_declaration_order(spark):
    dims = requests.wind_dimensions(T.wind_requests(spark, SF))
    turbines = dims["turbines"].orderBy("ordinal").collect()
    assert len(turbines) == 10
    assert [t.turbine_id for t in turbines] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    assert dims["points"].count() == 50 and dims["links"].count() == 10


def test_write_results_overwrites_only_its_plants(spark, tmp_path):
    plants = T.metered_plants(spark, SF)
    hourly = T.metered_energy(spark, SF)
    base = str(tmp_path / "results")

    def results(h):
        return solar_plant.results(h, plants)

    first = sinks.write_results(hourly, base, results)
    assert set(first) == {"hourly", "monthly", "daily", "firm", "surplus"}
    before = {r.plant_id: r.firm_kwh_day for r in first["firm"].collect()}
    doubled = hourly.filter("plant_id = 3").withColumn("kwh", F.col("kwh") * 2)
    again = sinks.write_results(doubled, base, results)
    after = {r.plant_id: r.firm_kwh_day for r in again["firm"].collect()}
    assert before.keys() == after.keys()
    assert all(before[k] == after[k] for k in before if k != 3)
    assert again["hourly"].count() == hourly.count()
    assert again["surplus"].count() == 12 * len(before)


def test_shared_folder_follows_the_cluster_setting(spark):
    conf = {"spark.checkpoint.dir": "hdfs://shared/work/"}
    session = SimpleNamespace(conf=conf)
    assert sinks.shared_folder(session).startswith("hdfs://shared/work/")
    assert sinks.shared_folder(session) != sinks.shared_folder(session)
    assert sinks.stage(spark.range(3)).count() == 3


def test_stream_takes_each_request_once(spark, tmp_path):
    incoming, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    T.plain_requests(spark, SF).write.json(incoming)
    ingest_requests(spark, incoming, checkpoint, append_to(out))
    ingest_requests(spark, incoming, checkpoint, append_to(out))
    got = spark.read.parquet(out)
    assert got.count() == 10
    wrong = got.filter((F.col("route") == "rejected") != (~F.col("TipoMensaje").isin(0, 1)))
    assert wrong.count() == 0


def test_stream_fills_the_dimension_tables(spark, tmp_path):
    """A repeated batch changes nothing, bad bodies end as dead letters, the last request counts."""
    from firmwatt.checks import tables as T
    from firmwatt.plans import wind_plant
    from firmwatt.sources.requests import with_route
    from firmwatt.streaming.requests import dead_letters, dimensions_of, fan_out_to

    sf, base = "/root/testdata/sf0.001", str(tmp_path)
    bad = spark.createDataFrame([(901, 1, "{not json"), (902, 7, "{}"), (903, 0, None)], T.REQUEST_SCHEMA)
    good = T.wind_requests(spark, sf)
    handle = fan_out_to(base)
    for _ in range(2):
        handle(with_route(good.unionByName(bad)), 0)
    dims = dimensions_of(spark, base, "wind")
    expected = T.turbines(spark, sf).count()
    assert dims["turbines"].count() == expected and dims["plants"].count() == good.count()
    assert dimensions_of(spark, base, "solar")["plants"].count() == 0
    letters = {r["plant_id"]: r["message"] for r in dead_letters(spark, base).collect()}
    assert letters == {901: "request cannot be read", 902: "unknown plant kind", 903: "request cannot be read"}
    renamed = good.withColumn("CuerpoMensaje", F.regexp_replace("CuerpoMensaje", "farm ", "renamed "))
    handle(with_route(renamed), 1)
    dims = dimensions_of(spark, base, "wind")
    assert dims["turbines"].count() == expected
    assert all(r["name"].startswith("renamed") for r in dims["plants"].collect())
    series = T.wind_inputs(spark, sf).series.withColumn("series_id", T.series_file(F.col("series_id")))
    inputs = wind_plant.from_dimensions(dims, series)
    assert not wind_plant.status(inputs).filter("n_bad > 0").count()


def test_one_series_of_many_towers_is_dealt_evenly(spark):
    """Rows of one series are spread before they fan out, and each is cleaned before that."""
    raw = spark.range(0, 400, 1, 1).selectExpr(
        "id AS event_id", "7L AS series_id", "'2008' AS Ano", "'1' AS Mes", "'1' AS Dia", "'3' AS Hora",
        "'75,25' AS DireccionViento", "'990,5' AS PresionAtmosferica", "'28,5' AS Ta", "concat(id, ',5') AS VelocidadViento",
    )
    towers = sinks.stage(spark.range(30).selectExpr("id % 2 AS plant_id", "id AS tower_id", "7L AS series_id"))
    tagged = series.tag_towers(raw, towers, "series_id")
    assert tagged.columns == ["event_id", "plant_id", "tower_id", "ts", "direction", "pressure", "ta", "wind"]
    sizes = [r["count"] for r in tagged.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12000 and max(sizes) <= 4 * 12000 / spark.sparkContext.defaultParallelism
    assert tagged.groupBy("event_id", "wind").count().filter("count = 30 AND wind = event_id + 0.5").count() == 400
    named = series.tag_towers(raw, towers, "series_id", ["event_id", F.round("wind").alias("w")])
    assert named.columns == ["plant_id", "tower_id", "event_id", "w"]


def test_a_task_has_few_series_of_many_towers(spark):
    """Each task fans out a stretch of the readings by series, so its rows repeat the same towers."""
    raw = spark.range(6000).selectExpr(
        "nullif(id % 4, 3) AS series_id", "'2024' AS Ano", "'1' AS Mes", "'2' AS Dia", "'3' AS Hora",
        "'75,25' AS DireccionViento", "'990,5' AS PresionAtmosferica", "'28,5' AS Ta", "'7,5' AS VelocidadViento",
    )
    towers = sinks.stage(spark.range(31).selectExpr("id % 2 AS plant_id", "id AS tower_id", "CASE WHEN id < 30 THEN id % 3 END AS series_id"))
    tagged = series.tag_towers(raw, towers, "series_id")
    tasks = tagged.groupBy(F.spark_partition_id().alias("task"), F.expr("tower_id % 3 AS series")).count().collect()
    assert sum(r["count"] for r in tasks) == 1500 * 30 and len({r["series"] for r in tasks}) == 3
    assert len(tasks) <= len({r["task"] for r in tasks}) + 2  # a stretch ends where the next begins
    assert max(r["count"] for r in tasks) <= 4 * 45000 / spark.sparkContext.defaultParallelism


def test_files_of_a_result_table_do_not_grow_with_the_plants(spark, tmp_path):
    """A rerun replaces its plants only, also those that share a part, and the plant without an id."""
    path = str(tmp_path / "table")
    ids = spark.range(1500).selectExpr("nullif(id, 0) AS plant_id", "id * 1.5D AS kwh", "'a' AS run")
    first = sinks.write_table(ids, path)
    assert len(list((tmp_path / "table").glob("*/*.parquet"))) <= 2 * sinks.PLANT_BUCKETS
    assert first.columns == ["plant_id", "kwh", "run"] and first.count() == 1500
    again = ids.filter("plant_id IS NULL OR plant_id % 300 = 1").withColumn("run", F.lit("b"))
    table = sinks.write_table(again.unionByName(again), path)
    got = {(r.plant_id, r.run): r["count"] for r in table.groupBy("plant_id", "run").count().collect()}
    new = {None, 1, 301, 601, 901, 1201}
    assert got == {(p, "b" if p in new else "a"): 2 if p in new else 1 for p in [None, *range(1, 1500)]}

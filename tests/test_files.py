"""Series by file: a missing or unreadable one fails the plants that name it and no others."""

from pyspark.sql import functions as F

from firmwatt import schemas
from firmwatt.checks import tables as T
from firmwatt.operators.cleaning import clean_wind
from firmwatt.plans import solar_plant, wind_plant
from firmwatt.sources import files

SF = "/root/testdata/sf0.01"
ROW = ("2008", "1", "1", "12", "0,5", "990,5", "20,5", "7,25")


def damage(path, at, data):
    content = bytearray(path.read_bytes())
    content[at : at + len(data)] = data
    path.write_bytes(bytes(content))


def one_file(spark, base, name, rows=1):
    """A file of one part, written by Spark, as a plain file ``name``."""
    spark.range(1).selectExpr(*[f"'{v}' AS {c.split()[0]}" for v, c in zip(ROW, schemas.RAW_WIND.split(", "))]).withColumn(
        "_n", F.explode(F.sequence(F.lit(1), F.lit(rows)))
    ).withColumn("Hora", (F.col("_n") % 24).cast("string")).drop("_n").coalesce(1).write.parquet(str(base / "tmp"))
    part = next((base / "tmp").glob("part-*.parquet"))
    to = base / "in" / name
    to.parent.mkdir(parents=True, exist_ok=True)
    to.write_bytes(part.read_bytes())
    for old in (base / "tmp").iterdir():
        old.unlink()
    (base / "tmp").rmdir()
    return to


def test_each_kind_of_damage(spark, tmp_path):
    good = one_file(spark, tmp_path, "a b+c%/good.parquet", rows=30)
    one_file(spark, tmp_path, "good.parquet", rows=2)
    one_file(spark, tmp_path, "unnamed.parquet")
    footer = one_file(spark, tmp_path, "footer.parquet")
    damage(footer, footer.stat().st_size - 4, b"XXXX")
    page = one_file(spark, tmp_path, "page.parquet", rows=30)
    damage(page, 4, b"\xff" * 60)
    (tmp_path / "in" / "empty.parquet").write_bytes(b"")
    spark.range(3).withColumn("Ano", F.col("id")).coalesce(1).write.parquet(str(tmp_path / "in" / "types.parquet"))
    (tmp_path / "in" / "notes.txt").write_text("no series")
    names = [
        (1, "a b+c%/good.parquet"), (1, "a b+c%/good.parquet"), (2, "good.parquet"), (3, "good.parquet"),
        (3, "footer.parquet"), (4, "page.parquet"), (5, "empty.parquet"), (6, "types.parquet"), (7, "none.parquet"), (8, None),
    ]
    names = spark.createDataFrame(names, "plant_id long, series_file string")
    found = files.named_series(spark, str(tmp_path / "in"), names, schemas.RAW_WIND, clean_wind)
    problems = {(r["plant_id"], r["series_file"]): r["problem"] for r in found.files.collect()}
    assert problems == {
        (1, "a b+c%/good.parquet"): None, (2, "good.parquet"): None, (3, "good.parquet"): None,
        (3, "footer.parquet"): "unreadable", (4, "page.parquet"): "unreadable", (5, "empty.parquet"): "missing",
        (6, "types.parquet"): "unreadable", (7, "none.parquet"): "missing", (8, None): "missing",
    }
    rows = {r["series_id"]: r["count"] for r in found.series.groupBy("series_id").count().collect()}
    assert rows == {"a b+c%/good.parquet": 30, "good.parquet": 2} and good.exists()
    bad = {(r["plant_id"], r["message"]) for r in found.status().filter("n_bad > 0").collect()}
    unreadable = "series file cannot be read"
    assert bad == {(p, unreadable) for p in (3, 4, 6)} | {(p, "series file is missing") for p in (5, 7, 8)}


def test_wind_inputs_from_files(spark, tmp_path):
    """The same inputs as from a table; the plants of one lost file leave, the others stay."""
    base = str(tmp_path / "in")
    raw = T.raw_wind(spark, SF).filter("Mes = '1' AND Dia = '2'").drop("event_id")
    for number in range(T.STATIONS):
        rows = raw.filter(F.col("series_id") == number).drop("series_id")
        rows.coalesce(1).write.parquet(f"{base}/station-{number}.parquet")
    requests = T.wind_requests(spark, SF)
    inputs, status = wind_plant.from_files(requests, base)
    plants = {r["plant_id"] for r in requests.select("plant_id").collect()}
    assert {r["plant_id"] for r in status.collect()} == plants and not status.filter("n_bad > 0").count()
    names = wind_plant.series_names(wind_plant.plant_requests.wind_dimensions(requests))
    driven = [(r["plant_id"], r["series_file"]) for r in names.collect()]
    table = clean_wind(raw).withColumn("series_id", T.series_file(F.col("series_id")))
    table = table.filter(F.col("series_id").isin([f for _, f in driven])).select("series_id", "ts", *wind_plant.WEATHER)
    read = inputs.series.select(*table.columns)
    assert read.count() and not read.exceptAll(table).count() and not table.exceptAll(read).count()
    lost = driven[0][1]
    for part in (tmp_path / "in" / lost).glob("part-*"):
        part.write_bytes(b"PAR1 lost PAR1")
    failing = {p for p, f in driven if f == lost}
    assert failing and failing != plants
    inputs, status = wind_plant.from_files(requests, base)
    assert {r["plant_id"] for r in status.filter("n_bad > 0").collect()} == failing
    for df in (inputs.plants, inputs.turbines, inputs.links):
        assert {r["plant_id"] for r in df.select("plant_id").distinct().collect()} == plants - failing


def test_solar_inputs_from_files(spark, tmp_path):
    """Readings come in Wh with the plant that names their file; a plant without one is left out."""
    rows = spark.createDataFrame([("2008", "1", "1", "12", "0,5", "20,5")], schemas.RAW_SOLAR)
    requests = T.solar_requests(spark, SF)
    dims = solar_plant.plant_requests.solar_dimensions(requests)
    named = {r["plant_id"]: r["series_file"] for r in dims["plants"].select("plant_id", "series_file").collect()}
    lost = min(named.values())
    for name in set(named.values()) - {lost}:
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / name))
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "unnamed.parquet"))
    inputs, status = solar_plant.from_files(requests, str(tmp_path / "in"), T.module_names(spark, SF))
    failing = {p for p, f in named.items() if f == lost}
    assert {r["plant_id"] for r in status.filter("n_bad > 0").collect()} == failing
    assert {r["plant_id"] for r in inputs.plants.select("plant_id").collect()} == set(named) - failing
    read = {(r["plant_id"], r["ghi"], r["ta"], r["back_irradiance"]) for r in inputs.series.collect()}
    assert read == {(p, 500.0, 20.5, None) for p in set(named) - failing} != set()

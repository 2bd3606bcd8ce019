"""A plant with a faulty input leaves with a status row; the energy of all others stays."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmwatt.checks import tables as T
from firmwatt.checks.oracles import dense_spline
from firmwatt.operators import curves
from firmwatt.plans import solar_plant, wind_plant

SF = "/root/testdata/sf0.01"


def short(series):
    """The first day of the weather."""
    first = series.agg(F.min("ts")).first()[0]
    return series.filter(F.col("ts") < F.lit(first) + F.expr("INTERVAL 1 DAY"))


def changed(df, where, **values):
    return df.withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def energy(checked):
    found = checked.hourly.groupBy("plant_id").agg(F.sum("kwh").alias("kwh")).collect()
    return {r["plant_id"]: r["kwh"] for r in found}


def failed(checked):
    return {(r["plant_id"], r["task"]) for r in checked.status.filter("n_bad > 0").collect()}


@pytest.fixture(scope="module")
def wind(spark):
    inputs = T.wind_inputs(spark, SF)
    inputs = replace(inputs, series=short(inputs.series))
    return inputs, energy(wind_plant.checked_energy(inputs))


def own_series(inputs, plant):
    """The inputs with a series of its own, 100 + plant, for a plant without towers."""
    here = F.col("plant_id") == plant
    more = inputs.series.filter(F.col("series_id") == plant % 5).withColumn("series_id", F.lit(100 + plant).cast("long"))
    moved = changed(inputs.plants, here, measured=False, series_id=100 + plant)
    return replace(inputs, plants=moved, series=inputs.series.unionByName(more))


def own_model(inputs, plant, name, **values):
    """One turbine of the plant with a model of its own."""
    rows = lambda df: df.filter("model_id = 'M1'").withColumn("model_id", F.lit(name))
    one = (F.col("plant_id") == plant) & (F.col("ordinal") == 1)
    model = rows(inputs.models)
    return replace(
        inputs,
        turbines=changed(inputs.turbines, one, model_id=name),
        models=inputs.models.unionByName(changed(model, F.lit(True), **values) if values else model),
        points=inputs.points.unionByName(rows(inputs.points)),
    )


def turbine(plant):
    return (F.col("plant_id") == plant) & (F.col("ordinal") == 2)


def wind_faults_of_tables(inputs):
    for plant in (1, 3):
        inputs = own_series(inputs, plant)
    twice = inputs.series.filter("series_id = 103").limit(1)
    series = changed(inputs.series, (F.col("series_id") == 101) & (F.hour("ts") == 3), pressure=3000.0).union(twice)
    inputs = own_model(replace(inputs, series=series), 4, "MR", rotor_d=None)
    inputs = replace(inputs, turbines=changed(inputs.turbines, turbine(2), lat=float("nan")))
    return inputs, {(1, "pressure"), (2, "coordinates"), (3, "stamps"), (4, "wake_radius")}


def wind_faults_of_hours(inputs):
    inputs = own_model(own_series(inputs, 3), 1, "MT")
    inputs = own_model(inputs, 2, "MC", v_max=2.5)
    at = (F.col("model_id") == "MT") & (F.col("idx") == 9)
    stampless = inputs.series.filter("series_id = 103").limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    inputs = replace(
        inputs,
        points=changed(inputs.points, at, ct=float("inf")),
        series=inputs.series.union(stampless),
        turbines=changed(inputs.turbines, turbine(4), elev=None),
    )
    return inputs, {(1, "thrust"), (2, "curves"), (3, "stamps"), (4, "distance")}


@pytest.mark.parametrize("fault", [wind_faults_of_tables, wind_faults_of_hours])
def test_wind_plants_fail_alone(wind, fault):
    inputs, good = wind
    faulty, expected = fault(inputs)
    checked = wind_plant.checked_energy(faulty)
    assert failed(checked) == expected
    assert energy(checked) == pytest.approx({0: good[0]}, rel=1e-12)


def test_solar_plants_fail_alone(spark):
    inputs = T.solar_inputs(spark, SF)
    inputs = replace(inputs, series=short(inputs.series))
    good = energy(solar_plant.checked_energy(inputs))
    at = lambda plant: (F.col("plant_id") == plant) & (F.col("inverter_id") % 4 == 1)
    noon = lambda plant: (F.col("plant_id") == plant) & (F.hour("ts") == 12)
    here = F.col("plant_id")
    modules = changed(changed(changed(inputs.modules, at(1), a_ref=None), at(2), t_noct=float("nan")), here == 11, bifacial=True)
    twice = inputs.series.filter(here == 5)
    series = changed(changed(inputs.series, noon(6), ghi=None), noon(7), ts=None)
    series = changed(series, noon(11), back_irradiance=None).filter(here != 12).unionByName(twice)
    faulty = solar_plant.SolarInputs(
        plants=changed(changed(inputs.plants, here == 8, lat=104.6), here == 9, albedo=None),
        inverters=changed(inputs.inverters, at(10), paco=None).unionByName(inputs.inverters.filter(at(14))),
        arrays=changed(inputs.arrays.filter(~at(4)), at(13), strings=None),
        modules=modules.filter(~at(3)),
        series=series,
    )
    checked = solar_plant.checked_energy(faulty)
    expected = {
        1: "circuits", 2: "modules", 3: "modules", 4: "arrays", 5: "stamps", 6: "values", 8: "coordinates", 9: "plant",
        10: "inverters", 11: "values", 12: "series", 13: "array_values", 14: "repeated", 7: "stamps",
    }
    found = failed(checked)
    assert {(p, t) for p, t in expected.items()} <= found
    assert {p for p, _ in found} == set(expected)
    assert energy(checked) == pytest.approx({p: k for p, k in good.items() if p not in expected}, rel=1e-12)


def test_splines_equal_the_dense_solve(spark):
    draw, rows, want = np.random.default_rng(8), [], {}
    for n in (4, 5, 6, 25, 200):
        x = np.sort(draw.choice(np.arange(1, 2000), n, replace=False)) * 0.02
        y, z = draw.normal(size=n) * 1000, draw.random(n)
        rows += [(f"m{n}", 1.2, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))]
        want[f"m{n}"] = {"p": dense_spline(x, y), "ct": dense_spline(x, z)}
    corrected = spark.createDataFrame(rows, "model_id string, rho_mean double, idx int, vcth double, p double, ct double")
    found = {r["model_id"]: r["curve"] for r in curves.curve_segments(corrected).collect()}
    assert found.keys() == want.keys()
    for name, curve in found.items():
        for q in ("p", "ct"):
            got = np.array(curve[q]).reshape(-1, 4)
            scale = np.abs(want[name][q]).max(axis=0)
            assert np.abs(got - want[name][q]).max(axis=0) == pytest.approx(0 * scale, abs=1e-9 * scale.max())


def test_no_segments_below_four_points(spark):
    rows = [("few", 1.0, i, v, v, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0])]
    rows += [("hole", 1.0, i, float(i), None if i == 2 else 1.0, 1.0) for i in range(6)]
    corrected = spark.createDataFrame(rows, "model_id string, rho_mean double, idx int, vcth double, p double, ct double")
    assert curves.curve_segments(corrected).count() == 0


@pytest.mark.parametrize("per_bin", [1, 40, 300])
def test_lookup_finds_the_cubic_in_crowded_bins(spark, per_bin):
    """Also above the number of comparisons that generated code takes."""
    x = np.unique(np.concatenate((np.arange(0.5, 30), 7 + np.arange(per_bin) / per_bin, [64.0, 70.0])))
    y = np.sin(x) * 100
    rows = [("m", 1.0, i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    corrected = spark.createDataFrame(rows, "model_id string, rho_mean double, idx int, vcth double, p double, ct double")
    segments = curves.curve_segments(corrected)
    speeds = np.concatenate((x, np.linspace(-2, 75, 400), [7.0, 7.999, 8.0]))
    probe = spark.createDataFrame([("m", 1.0, float(v)) for v in speeds], "model_id string, rho_mean double, v double")
    coefficients = dense_spline(x, y)
    for r in curves.curve_lookup(probe, segments, "p", "v", "found").collect():
        i = int(np.clip(np.searchsorted(x, r["v"], side="right") - 1, 0, len(x) - 2))
        d = r["v"] - x[i]
        assert r["found"] == pytest.approx(coefficients[i] @ [1, d, d * d, d**3], rel=1e-6, abs=1e-6)


def test_a_model_on_nearly_all_turbines_is_no_hot_key(spark):
    """No exchange by the curve's keys: hours read the curve of their own turbine."""
    inputs = T.wind_inputs(spark, SF)
    turbines = inputs.turbines.withColumn("model_id", F.when(F.col("ordinal") == 19, "M1").otherwise("M0"))
    inputs = replace(inputs, turbines=turbines)
    static = wind_plant.static_turbines(inputs)
    segments = wind_plant.segments_in_use(inputs, static)
    armed = curves.with_curves(static, segments)
    armed = spark.createDataFrame(armed.collect(), armed.schema)
    free = wind_plant.free_speeds(armed, curves.with_density(inputs.series))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = wind_plant.wake_inputs(armed, free, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert exchanges and not any("model_id" in line or "rho_mean" in line for line in exchanges)

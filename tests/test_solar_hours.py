"""Inverter output of all hours: lit ones through their arrays, dark ones once per inverter."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from firmwatt.checks import tables as T
from firmwatt.operators import energy, inverter, irradiance
from firmwatt.plans import solar_plant
from firmwatt.sources import sinks

SF = "/root/testdata/sf0.001"


def by_window(array_hours, inverters, fit):
    """Each array's share of its inverter's output, row by row."""
    col, unit = F.col, Window.partitionBy(*inverter.KEY, "ts")
    rows = array_hours.withColumn("p_dc", F.sum("p_mp").over(unit)).join(inverters.join(fit, inverter.KEY), inverter.KEY)
    dv = col("v_mp") - col("vdco")
    a, b = col("pdco") * (1 + col("c1") * dv), col("pso") * (1 + col("c2") * dv)
    c, above = col("c0") * (1 + col("c3") * dv), col("p_dc") - b
    one = (col("paco") / (a - b) - c * (a - b)) * above + c * above * above
    ac = F.sum(F.try_divide(col("p_mp"), col("p_dc")) * one)
    summed = rows.groupBy(*inverter.KEY, "ts").agg(
        ac.alias("ac"), *[F.any_value(n).alias(n) for n in ("p_dc", "pso", "pnt", "paco", "n_inv")]
    )
    limited = F.when(col("p_dc") < col("pso"), -F.abs("pnt")).otherwise(F.when(col("ac") > col("paco"), col("paco")).otherwise(col("ac")))
    return summed.select(*inverter.KEY, "ts", (F.when(limited < 0, 0.0).otherwise(limited) * col("n_inv")).alias("p_ac"))


def test_lit_and_dark_hours_against_every_array_hour(spark):
    inputs = T.solar_inputs(spark, SF)
    # a repeated nameplate, a start power of 0, repeated hours and one without irradiance
    units = inputs.inverters.withColumn("pso", F.when(F.col("inverter_id") == 2, 0.0).otherwise(F.col("pso")))
    units = sinks.stage(units.unionByName(units.filter("inverter_id = 1")))
    fit = sinks.stage(inverter.inverter_fit(inverter.inverter_samples(inputs.inverters)))
    early = inputs.series.filter(F.col("ts") < dt.datetime(2024, 1, 4))
    early = early.withColumn("ghi", F.when(F.hour("ts") != 11, F.col("ghi")))
    hours = irradiance.irradiance_by_plant(early, inputs.plants)
    hours = hours.unionByName(hours.filter(F.hour("ts").isin(3, 12)))
    hours = sinks.stage(hours.unionByName(hours.filter(F.hour("ts") == 10).withColumns({"dni": F.lit(0.0), "dhi": F.lit(0.0)})))
    arrays = sinks.stage(solar_plant.static_arrays(inputs))
    every = solar_plant.array_output(solar_plant.plane_of_arrays(hours, arrays))
    key = lambda r: (r.plant_id, r.inverter_id, r.ts)
    want = {key(r): r.p_ac for r in by_window(every, units, fit).collect()}
    rated = sinks.stage(inverter.with_nameplate(arrays, units, fit))
    found = solar_plant.inverter_hours(hours, rated).collect()
    assert len(found) == len(want) and max(want[k] for k in want if want[k] is not None) > 0
    assert None in want.values()
    for r in found:
        assert r.p_ac == (None if want[key(r)] is None else pytest.approx(want[key(r)], abs=1e-5))
    for r in inverter.inverter_ac(every, units, fit).collect():
        assert r.p_ac == (None if want[key(r)] is None else pytest.approx(want[key(r)], abs=1e-5))


def test_array_hours_are_neither_sorted_nor_shuffled(spark):
    inputs = T.solar_inputs(spark, SF)
    fit = inverter.inverter_fit(inverter.inverter_samples(inputs.inverters))
    rated = sinks.stage(inverter.with_nameplate(solar_plant.static_arrays(inputs), inputs.inverters, fit))
    hours = sinks.stage(irradiance.irradiance_by_plant(inputs.series, inputs.plants))
    plan = solar_plant.inverter_hours(hours, rated)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    # the dealt hours, for lit and for dark ones, and the small sums of an idle inverter
    assert plan.count("Exchange hashpartitioning(plant_id") <= 3
    assert energy.hourly_energy_solar(solar_plant.inverter_hours(hours, rated)).count() == hours.count()


def test_requested_series_fan_out_in_many_tasks(spark):
    series = T.weather(spark, SF).select(
        T.series_file(F.col("series_id")).alias("series_id"), "ts", "ghi", "ta", F.lit(0.0).alias("back_irradiance")
    )
    inputs = solar_plant.from_requests(T.solar_requests(spark, SF), series, T.module_names(spark, SF))
    tasks = inputs.series.groupBy(F.spark_partition_id().alias("task")).count().collect()
    total = sum(t["count"] for t in tasks)
    assert total and max(t["count"] for t in tasks) < total / 2

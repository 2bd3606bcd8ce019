"""Small inputs with literal answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from firmwatt.functions import geo
from firmwatt.functions.text import decimal_comma, technology_code
from firmwatt.operators import (
    array_power,
    cleaning,
    curves,
    energy,
    inverter,
    irradiance,
    layout,
    quality,
    turbine_power,
)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_distance(spark):
    lit = [F.lit(v) for v in (12.24802, -71.26422, 34.0, 12.29263, -71.27683, 35.0)]
    assert one(spark, geo.distance_km(*lit))[0] == pytest.approx(5.14615, abs=1e-5)


def test_downwind_distance(spark):
    direction = F.lit(90 - math.degrees(0.12))
    x = layout.downwind_distance(
        direction, F.lit(12.29263), F.lit(-71.226417), F.lit(12.287679), F.lit(-71.226417)
    )
    assert one(spark, x)[0] == pytest.approx(65.9046, abs=1e-3)


def _cables(spark, links):
    turbines = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 0.0), (1, 2, 1.0, 1.0, 1.0)],
        "plant_id int, turbine_id int, lat double, lon double, elev double",
    )
    plants = spark.createDataFrame(
        [(1, 2.0, 2.0, 2.0)], "plant_id int, pcc_lat double, pcc_lon double, pcc_elev double"
    )
    links = spark.createDataFrame(links, "plant_id int, string_pos int, pos int, turbine_id int")
    return layout.cable_hops(links, turbines, plants)


def test_cable_path(spark):
    hops = _cables(spark, [(1, 0, 0, 1), (1, 0, 1, 2)])
    assert [r.next_hop for r in hops.orderBy("pos").collect()] == ["2", "pcc"]
    expected = [(1, 1, 314.4748), (1, 2, 157.2254)]
    assert rows(layout.cable_path(hops), "turbine_id") == expected
    # The same across a block boundary.
    assert rows(layout.cable_path(hops, block=1), "turbine_id") == expected


def test_cable_path_keeps_first_string(spark):
    hops = _cables(spark, [(1, 0, 0, 2), (1, 1, 0, 2), (1, 1, 1, 1)])
    assert rows(layout.cable_path(hops), "turbine_id")[1] == (1, 2, 157.2254)


def test_losses(spark):
    lit = F.lit
    cable = turbine_power.after_cable(lit(150.86), lit(0.036), lit(0.2), lit(33.0))
    connection = turbine_power.after_connection(lit(150.86), lit(0.2), lit(0.5), lit(0.0))
    got = one(spark, cable, connection)
    assert got[0] == pytest.approx(-115750.128, abs=1e-2)
    assert got[1] == pytest.approx(149.8039, abs=1e-4)


def test_temperature_bounds_are_allowed(spark):
    gate = lambda t: turbine_power.within_temperature(
        F.lit(5.0), F.lit(t), F.lit(-10.0), F.lit(45.0)
    )
    assert list(one(spark, gate(-10.0), gate(45.0), gate(45.1), gate(-10.1))) == [5.0, 5.0, 0.0, 0.0]


def test_design_speed(spark):
    points = spark.createDataFrame(
        [("a", 0, 1.0, 0.0), ("a", 1, 2.0, 3.6), ("b", 0, 0.0, 5.0), ("b", 1, 1.0, 0.0)],
        "model_id string, idx int, v double, p double",
    )
    assert rows(curves.design_speed(points), "model_id") == [("a", 2.0), ("b", 0.0)]


def test_mean_density(spark):
    values = spark.createDataFrame(
        [(1, v) for v in (20.0, 50.0, 20.0, 5.0, 5.0)], "series_id int, rho double"
    )
    assert rows(curves.mean_density(values), "series_id") == [(1, 20.0)]


def test_terrain(spark):
    plants = spark.createDataFrame([(1, True), (2, False)], "plant_id int, offshore boolean")
    assert rows(layout.terrain_constants(plants), "plant_id") == [
        (1, True, 0.0002, 0.03, 0.04),
        (2, False, 0.055, 0.05, 0.075),
    ]


def test_disc(spark):
    df = spark.createDataFrame(
        [(50.0, 0.5), (100.0, 0.6), (150.0, 0.7)], "zenith double, ghi double"
    ).withColumn("ts", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    got = irradiance.beam_disc(df).orderBy("zenith").collect()
    assert [r.kt for r in got] == pytest.approx([0.000549, 0.006510, 0.007595], abs=1e-6)
    assert [r.airmass for r in got] == pytest.approx([1.552552, 0, 0], abs=1e-6)
    assert [r.dni for r in got] == [0, 0, 0]


def test_dhi_and_panel_temperature(spark):
    df = spark.createDataFrame(
        [(0.30, 0.65, 119.236, 657.430433, 26.49, 45.0)],
        "ghi double, dni double, zenith double, poa double, ta double, t_noct double",
    )
    value = F.col("ghi") - F.col("dni") * F.cos(F.radians("zenith"))
    assert df.select(value).first()[0] == pytest.approx(0.617465223348021, abs=1e-12)
    assert array_power.panel_temperature(df).first().temp == pytest.approx(47.03470103125)


def test_circuit_current(spark):
    df = spark.createDataFrame(
        [(100.0, 25.0), (200.0, 30.0), (300.0, 35.0)], "poa double, temp double"
    )
    constants = {
        "il_ref": 1.0, "alpha_sc": 0.05, "adjust": 6.0, "i0_ref": 1e-10, "rs_ref": 0.2,
        "rsh_ref": 300.0, "a_ref": 1.5,
    }
    df = df.withColumns({k: F.lit(v) for k, v in constants.items()})
    got = [r.il for r in array_power.circuit_params(df).orderBy("poa").collect()]
    assert got == pytest.approx([0.100, 0.247, 0.441])


def test_dc_losses(spark):
    df = spark.createDataFrame(
        [(10.0, 10.0, 0.1, 0.2)], "i_mp double, p_mp double, psi double, l_pct double"
    )
    got = array_power.dc_losses(df).first()
    assert (got.i_mp, got.p_mp) == pytest.approx((9.97002, 9.97002))


def test_hourly_energy_solar(spark):
    data = [(i, h, p) for i, ps in enumerate([(1e3, 2e3, 3e3), (2e3, 3e3, 4e3)]) for h, p in enumerate(ps)]
    df = spark.createDataFrame(data, "inverter_id int, ts int, p_ac double").withColumn(
        "plant_id", F.lit(1)
    )
    assert [r[2] for r in rows(energy.hourly_energy_solar(df), "ts")] == [3.0, 5.0, 7.0]


def test_monthly_energy_sums_and_gaps(spark):
    start = dt.datetime(2023, 1, 1)
    data = [(1, start + dt.timedelta(days=i), float(i)) for i in range(90)]
    data += [(2, dt.datetime(2023, 1, 5), 4.0), (2, dt.datetime(2023, 4, 5), 6.0)]
    df = spark.createDataFrame(data, "plant_id int, ts timestamp_ntz, kwh double")
    got = rows(energy.monthly_energy(df), "plant_id", "month")
    assert [r[2] for r in got] == [465, 1246, 2294, 4, 0, 0, 6]


def _daily(spark, first, values):
    data = [(1, dt.date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1), v)
            for i, v in enumerate(values)]
    return spark.createDataFrame(data, "plant_id int, month date, daily double")


def test_daily_equivalent(spark):
    monthly = _daily(spark, dt.date(2023, 1, 1), [1000.0, 900.0, 1200.0]).withColumnRenamed(
        "daily", "monthly"
    )
    got = [r.daily for r in energy.daily_equivalent(monthly).orderBy("month").collect()]
    assert got == [32.26, 32.14, 38.71]


@pytest.mark.parametrize(
    "operator, cen, ihf, measured, values, expected",
    [
        (energy.firm_energy_solar, 5.0, 20.0, True, [10.0, 20.0, 30.0], 10.0),
        (energy.firm_energy_solar, 5.0, 20.0, False, [10.0, 20.0, 30.0], 8.0),
        (energy.firm_energy_wind, 2.0, 87.0, True, [10000.0, 20000.0], 6240.0),
        (energy.firm_energy_wind, 2.0, 87.0, False, [10.0, 20.0], 6.0),
    ],
)
def test_firm_energy(spark, operator, cen, ihf, measured, values, expected):
    plants = spark.createDataFrame(
        [(1, cen, ihf, measured)], "plant_id int, cen double, ihf double, measured boolean"
    )
    got = operator(_daily(spark, dt.date(2023, 1, 1), values), plants).first()
    assert got.month == dt.date(2023, 1, 1)
    assert got.firm == pytest.approx(expected)


def test_daily_surplus(spark):
    daily = _daily(spark, dt.date(2008, 1, 1), [15.0, 20.0, 18.0])
    firm = spark.createDataFrame(
        [(1, dt.date(2008, 3, 1), True, 100.0)],
        "plant_id int, month date, measured boolean, firm double",
    )
    got = rows(energy.daily_surplus(daily, firm), "month")
    assert [r[2] for r in got] == [None, -85.0, -80.0, -82.0] + [None] * 8
    december = firm.withColumn("month", F.lit(dt.date(2008, 12, 1)))
    got = rows(energy.daily_surplus(daily, december), "month")
    assert got[0][1] == dt.date(2008, 12, 1) and [r[2] for r in got] == [None] * 12
    assert energy.out_surplus(energy.daily_surplus(daily, firm)).filter(
        "surplus_kwh_day = 'N/A'"
    ).count() == 9


def test_daylight_and_dark_rows(spark):
    data = [(dt.datetime(2024, 1, 1, h, m), dni, dhi) for h, m, dni, dhi in [
        (6, 0, 0.0, 0.0), (9, 0, 100.0, 0.0), (12, 0, 0.0, 50.0), (18, 0, 0.0, 0.0),
        (18, 30, 5.0, 5.0), (5, 59, 5.0, 5.0)]]
    df = spark.createDataFrame(data, "ts timestamp_ntz, dni double, dhi double")
    got = cleaning.drop_dark(cleaning.daylight(df))
    assert sorted(r.ts.hour for r in got.collect()) == [9, 12]
    assert cleaning.daylight(df).count() == 4


def test_restore_index(spark):
    spine = spark.createDataFrame([(1, 20.0), (2, 21.0), (3, 22.0)], "ts int, ta double")
    poa = spark.createDataFrame([(1, 1.0), (3, float("nan"))], "ts int, poa double")
    got = rows(cleaning.restore_index(spine, poa, ["ts"], ["poa"]), "ts")
    assert got == [(1, 20.0, 1.0), (2, 21.0, 0.0), (3, 22.0, 0.0)]


def test_text(spark):
    parsed = [decimal_comma(F.lit(t)) for t in ("12,5", "-3", "x")]
    assert list(one(spark, *parsed)) == [12.5, -3.0, None]
    codes = [technology_code(F.lit(t)) for t in ("mtSiPoly", "HIT-Si", "open_rack")]
    assert list(one(spark, *codes)) == ["poliSi", "amorphous", None]


def test_quality(spark):
    readings = spark.createDataFrame(
        [(1, 3100.0, 1), (1, 2900.0, 2), (1, 3050.0, 2), (2, 990.0, 1)],
        "plant_id int, pressure double, ts int",
    )
    status = quality.plant_status(
        quality.check_pressure(readings), quality.check_duplicates(readings, ["ts"])
    )
    got = {(r.plant_id, r.task): r.n_bad for r in status.collect()}
    assert got == {(1, "pressure"): 2, (2, "pressure"): 0, (1, "duplicates"): 1, (2, "duplicates"): 0}
    assert {r.plant_id for r in quality.accepted(readings, status).collect()} == {2}


def test_sun_position(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2003, 10, 17, 19, 30, 30), 39.742476, -105.1786)],
        "ts_utc timestamp_ntz, lat double, lon double",
    )
    got = irradiance.sun_position(df).first()
    assert (got.zenith, got.azimuth) == pytest.approx((50.130, 194.339), abs=2e-3)
    assert 0 < got.zenith - got.apparent_zenith < 0.05


def test_inverter_output_at_rated_power(spark):
    from firmwatt.checks.tables import INVERTER_AC, INVERTER_DC

    units = spark.createDataFrame(
        [(1, 1, 2, 2e5, 202507.04, 1174.0, 2025.07, 3.3, INVERTER_DC, INVERTER_AC)],
        "plant_id int, inverter_id int, n_inv int, paco double, pdco double, vdco double, "
        "pso double, pnt double, p_dc_points array<double>, p_ac_points array<double>",
    )
    fit = inverter.inverter_fit(inverter.inverter_samples(units))
    hours = spark.createDataFrame(
        [(1, 1, 1, 1174.0, 202507.04), (1, 1, 2, 1174.0, 10.0), (1, 1, 3, 1174.0, 9e5), (1, 1, 4, 0.0, 0.0)],
        "plant_id int, inverter_id int, ts int, v_mp double, p_mp double",
    )
    got = [r.p_ac for r in inverter.inverter_ac(hours, units, fit).orderBy("ts").collect()]
    assert got == pytest.approx([4e5, 0.0, 4e5, 0.0])
    split = hours.withColumn("p_mp", F.col("p_mp") / 2)
    halves = inverter.inverter_ac(split.unionAll(split), units, fit).orderBy("ts").collect()
    assert [r.p_ac for r in halves] == pytest.approx(got)

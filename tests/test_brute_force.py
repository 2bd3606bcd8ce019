"""Pruned joins and solvers against brute force on small random inputs."""

import math

import numpy as np
import pytest
from firmwatt.operators import array_power, curves, farm_correction, layout, wake


def _random_farm(seed, n, extent):
    rng = np.random.default_rng(seed)
    return [
        (1, int(i), float(x), float(y), float(z), float(r), 0.04 if seed % 2 else 0.075)
        for i, (x, y, z, r) in enumerate(
            zip(
                rng.uniform(-extent, extent, n),
                rng.uniform(-extent, extent, n),
                rng.uniform(0, 40, n),
                rng.uniform(20, 80, n),
            )
        )
    ]


FARM = "plant_id int, turbine_id int, x_m double, y_m double, dz_m double, radius double, cre double"


def _shares(turbines, direction):
    """Overlap of every pair by the plain formulas."""
    result = {}
    for (_, i, xi, yi, zi, _, _) in turbines:
        for (_, j, xj, yj, zj, t, cre) in turbines:
            phi = math.radians(90 - direction[j])
            u = (-math.cos(phi), -math.sin(phi))
            p = (xi - xj) * u[0] + (yi - yj) * u[1]
            if i == j or p <= 0:
                continue
            e = t + cre * p
            d = math.sqrt(
                (xi - xj - p * u[0]) ** 2 + (yi - yj - p * u[1]) ** 2 + (zi - zj) ** 2
            )
            if d < t + e:
                result[(i, j)] = d
    return result


def _candidates(spark, turbines, directions):
    """Candidates of all turbines in one hour per direction, as (hour, affected, source)."""
    hours = [(*t, h, float(d), 8.0, 0.5) for t in turbines for h, d in enumerate(directions)]
    hours = spark.createDataFrame(hours, FARM + ", ts int, direction double, wind double, thrust double")
    found = wake.wake_candidates(hours, wake.sector_tiles(spark.createDataFrame(turbines, FARM)))
    return [tuple(r) for r in found.select("ts", "turbine_id", "source_id").collect()]


@pytest.mark.parametrize("seed, n, extent", [(1, 40, 600.0), (2, 60, 4000.0), (3, 60, 15000.0)])
def test_no_interacting_pair_is_pruned(spark, seed, n, extent):
    turbines = _random_farm(seed, n, extent)
    rng = np.random.default_rng(seed)
    directions = [0.0, 9.999999, 10.0, 355.0, 359.9999999, *rng.uniform(0, 360, 60)]
    listed = _candidates(spark, turbines, directions)
    found = set(listed)
    assert len(found) == len(listed)
    for hour, direction in enumerate(directions):
        for i, j in _shares(turbines, {k: direction for k in range(n)}):
            assert (hour, i, j) in found


@pytest.mark.parametrize("n", [20, 100, 400])
def test_candidates_are_a_small_multiple_of_interacting_pairs(spark, n):
    """Farms of equal density: what an hour looks at grows with what interacts, and what is stored with n."""
    turbines = _random_farm(n, n, 300.0 * math.sqrt(n))
    directions = np.random.default_rng(n).uniform(0, 360, 12)
    found = _candidates(spark, turbines, directions)
    interacting = sum(len(_shares(turbines, {k: d for k in range(n)})) for d in directions)
    assert interacting <= len(found) <= 4 * interacting
    assert wake.sector_tiles(spark.createDataFrame(turbines, FARM)).count() == 36 * n


def test_farms_of_one_turbine_and_in_one_line(spark):
    assert _candidates(spark, [(1, 0, 0.0, 0.0, 0.0, 46.0, 0.075)], [0.0, 77.0]) == []
    line = [(1, i, 500.0 * i, 0.0, 0.0, 46.0, 0.075) for i in range(30)]
    found = set(_candidates(spark, line, [270.0, 90.0, 0.0]))
    for hour, direction in enumerate([270.0, 90.0, 0.0]):
        pairs = _shares(line, {k: direction for k in range(30)})
        assert {(hour, *p) for p in pairs} <= found
        assert len(pairs) == (0 if hour == 2 else 435)


def _published_share(t, e, d):
    """Covered share of a rotor by the published case distinction."""
    area = math.pi * t * t
    if d >= t + e:
        return 0.0
    if d + t < e:
        return 1.0
    chord = abs((t * t - e * e + d * d) / (2 * d))
    if chord > t or abs(d - chord) > e:
        return 0.0
    rotor = t * t * math.acos(chord / t)
    wake_part = e * e * math.acos((d - chord) / e) - d * math.sqrt(abs(t * t - chord * chord))
    outside = d >= e or d > math.sqrt(e * e - t * t)
    return ((rotor if outside else area - rotor) + wake_part) / area


def _wake_reference(turbines, wind, direction, thrust):
    slowed = dict(enumerate(wind))
    if max(thrust) > 1:
        return slowed
    loss = dict.fromkeys(slowed, 0.0)
    for (i, j), d in _shares(turbines, direction).items():
        _, _, xj, yj, _, t, cre = turbines[j]
        _, _, xi, yi, *_ = turbines[i]
        phi = math.radians(90 - direction[j])
        p = -(xi - xj) * math.cos(phi) - (yi - yj) * math.sin(phi)
        e = t + cre * p
        share = _published_share(t, e, d)
        slow = wind[j] * (1 - math.sqrt(1 - thrust[j])) * (t / e) ** 2
        loss[i] += share * slow**2
    return {i: max(0.0, v - math.sqrt(loss[i])) for i, v in slowed.items()}


@pytest.mark.parametrize("hot", [0.5, 1.2])
def test_wake_speeds(spark, hot):
    rng = np.random.default_rng(5)
    turbines = [(1, i, float(x), float(y), 0.0, 46.0, 0.075) for i, (x, y) in
                enumerate(rng.uniform(-1500, 1500, (25, 2)))]
    wind = rng.uniform(5, 12, 25)
    thrust = rng.uniform(0.3, 0.9, 25)
    thrust[3] = max(thrust[3], hot)
    direction = {i: float(rng.uniform(70, 75)) for i in range(25)}
    hours = spark.createDataFrame(
        [(1, 1, i, float(wind[i]), direction[i], 20.0, 1.2, float(thrust[i]), 46.0, 0.075)
         for i in range(25)],
        "plant_id int, ts int, turbine_id int, wind double, direction double, ta double, "
        "rho double, thrust double, radius double, cre double",
    )
    tiles = wake.sector_tiles(spark.createDataFrame(turbines, FARM))
    got = {r.turbine_id: r.wake_speed for r in wake.wake_speeds(hours, tiles).collect()}
    expected = _wake_reference(turbines, wind, direction, thrust)
    assert got.keys() == expected.keys()
    for i in expected:
        assert got[i] == pytest.approx(expected[i], abs=1e-9)
    if hot > 1:
        assert got == pytest.approx(dict(enumerate(wind)))
    else:
        assert sum(got[i] < wind[i] - 0.1 for i in got) >= 3


@pytest.mark.parametrize("seed, lat, lon", [(1, 12.0, -71.0), (2, 65.0, 179.95), (3, -89.5, 0.0)])
def test_nearest_tower(spark, seed, lat, lon):
    rng = np.random.default_rng(seed)

    def place(n):
        return [(float(max(-90, min(90, lat + a))), float((lon + b + 180) % 360 - 180), float(c))
                for a, b, c in zip(rng.uniform(-0.3, 0.3, n), rng.uniform(-0.3, 0.3, n),
                                   rng.uniform(0, 100, n))]

    towers = [(1, i, *p, float(rng.choice([0.5, 3.0, 12.0, 40.0]))) for i, p in enumerate(place(30))]
    turbines = [(1, 100 + i, *p, int(rng.integers(30))) for i, p in enumerate(place(60))]

    def km(a, b):
        la1, lo1, la2, lo2 = map(math.radians, (a[0], a[1], b[0], b[1]))
        h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        return math.sqrt((2 * 6371 * math.asin(math.sqrt(h))) ** 2 + ((b[2] - a[2]) / 1000) ** 2)

    expected = {}
    for _, t, la, lo, el, declared in turbines:
        near = [(km(w[2:5], (la, lo, el)), w[1]) for w in towers if km(w[2:5], (la, lo, el)) <= w[5]]
        ok = km(towers[declared][2:5], (la, lo, el)) <= towers[declared][5]
        expected[t] = declared if ok or not near else min(near)[1]
    got = layout.nearest_tower(
        spark.createDataFrame(turbines, "plant_id int, turbine_id int, lat double, lon double, "
                              "elev double, declared_tower int"),
        spark.createDataFrame(towers, "plant_id int, tower_id int, lat double, lon double, "
                              "elev double, radius_km double"),
    )
    assert {r.turbine_id: r.tower_id for r in got.collect()} == expected
    assert len(set(expected.values())) > 3


def test_segments_reproduce_a_cubic(spark):
    rows = [("m", 1.2, i, x, x**3 - 2 * x, float(i % 3)) for i, x in enumerate([1.0, 2.0, 2.5, 4.0, 7.0, 7.0, 9.0])]
    corrected = spark.createDataFrame(
        rows, "model_id string, rho_mean double, idx int, vcth double, p double, ct double"
    )
    segments = curves.curve_segments(corrected)
    speeds = [-3.0, 0.0, 1.0, 1.7, 2.5, 6.999, 8.0, 12.0, 75.0]
    probe = spark.createDataFrame(
        [(v, "m", 1.2) for v in speeds] + [(5.0, "none", 1.2)],
        "v double, model_id string, rho_mean double",
    )
    got = curves.curve_lookup(probe, segments, "p", "v", "found").orderBy("v").collect()
    assert len(got) == len(speeds) + 1
    for r in got:
        if r.model_id == "none":
            assert r.found is None
        else:
            assert r.found == pytest.approx(r.v**3 - 2 * r.v, rel=1e-9, abs=1e-9)
    # The other quantity passes through its points; the repeated speed keeps its first.
    knots = corrected.filter("idx <> 5").withColumnRenamed("vcth", "v")
    for r in curves.curve_lookup(knots, segments, "ct", "v", "found").collect():
        assert r.found == pytest.approx(r.ct, abs=1e-9)


def test_layer_height(spark):
    df = spark.createDataFrame(
        [(x, z) for x in (-5.0, 0.1, 1.0, 500.0, 1e5, 2e5) for z in (0.03, 0.05)],
        "x_dist double, z02 double",
    )
    for r in farm_correction.layer_height(df).collect():
        if not 0 < r.x_dist <= 1e4 * (math.log(1e4 / r.z02) - 1) / 0.9:
            assert r.ibl is None
        else:
            assert r.ibl * (math.log(r.ibl / r.z02) - 1) == pytest.approx(0.9 * r.x_dist, rel=1e-9)


def test_characteristic_points(spark):
    grid = [(il, i0, rs, rsh, a) for il in (0.01, 0.5, 14.0) for i0 in (1e-14, 2.2e-11, 1e-8)
            for rs in (0.05, 0.4) for rsh in (60.0, 4000.0) for a in (1.0, 2.5)]
    df = spark.createDataFrame(
        [(*g, 1000.0) for g in grid] + [(0.0, 1e-10, 0.2, None, 1.5, 0.0)],
        "il double, i0 double, rs double, rsh double, a double, poa double",
    )
    for r in array_power.max_power_point(df).collect():
        if r.rsh is None:
            assert (r.i_sc, r.v_oc, r.p_mp, r.i_x, r.i_xx) == (0, 0, 0, 0, 0)
            continue
        u = np.linspace(0, r.a * math.log(r.il / r.i0 + 1), 200001)
        i = r.il - r.i0 * np.expm1(u / r.a) - u / r.rsh
        v = u - i * r.rs
        power = i * v
        assert r.p_mp == pytest.approx(power.max(), rel=1e-6)
        assert r.p_mp == pytest.approx(r.i_mp * r.v_mp)
        assert r.v_oc == pytest.approx(np.interp(0, -i, v), rel=1e-6)
        assert r.i_sc == pytest.approx(np.interp(0, v, i), rel=1e-6)
        assert r.i_x == pytest.approx(np.interp(r.v_oc / 2, v, i), rel=1e-5)
        assert r.i_xx == pytest.approx(np.interp((r.v_oc + r.v_mp) / 2, v, i), rel=1e-4)


def test_ranking(spark):
    rng = np.random.default_rng(3)
    factors = [(1, t, k, float(rng.integers(5))) for t in range(4) for k in range(30)]
    df = spark.createDataFrame(factors, "plant_id int, ts int, turbine_id int, factor double")
    order = sorted(factors, key=lambda f: (f[1], -f[3], f[2]))
    got = layout.upwind_rank(df).orderBy("ts", "rank").collect()
    assert [(r.ts, r.turbine_id) for r in got] == [(f[1], f[2]) for f in order]
    leads = {r.ts: r.lead_id for r in layout.lead_turbine(df).collect()}
    assert leads == {t: next(f[2] for f in order if f[1] == t) for t in range(4)}


def test_fit_matches_least_squares(spark):
    from firmwatt.checks.tables import INVERTER_AC, INVERTER_DC
    from firmwatt.operators import inverter

    units = spark.createDataFrame(
        [(1, 1, 2e5, 1174.0, INVERTER_DC, INVERTER_AC)],
        "plant_id int, inverter_id int, paco double, vdco double, p_dc_points array<double>, "
        "p_ac_points array<double>",
    )
    got = inverter.inverter_fit(inverter.inverter_samples(units)).first()
    dc, ac = np.array(INVERTER_DC).reshape(3, 7), np.array(INVERTER_AC).reshape(3, 7)
    dv = np.array([9.93 + 0.874 * 1174 - 1174, 0.0, 66.45 + 1.123 * 1174 - 1174])
    quad, rated, start = [], [], []
    for x, y in zip(dc, ac):
        a, b, c = np.polyfit(x, y, 2)
        quad.append(a)
        rated.append((-b + math.sqrt(b * b - 4 * a * (c - 2e5))) / (2 * a))
        start.append((-b + math.sqrt(b * b - 4 * a * c)) / (2 * a))
    lines = [np.polyfit(dv, w, 1) for w in (quad, rated, start)]
    assert got.c0 == pytest.approx(lines[0][1], rel=1e-6)
    assert got.c3 == pytest.approx(lines[0][0] / lines[0][1], rel=1e-6)
    assert got.c1 == pytest.approx(lines[1][0] / lines[1][1], rel=1e-6)
    assert got.c2 == pytest.approx(lines[2][0] / lines[2][1], rel=1e-6)


def test_hours_of_the_wake_are_dealt_twice_at_most(spark):
    """Without a broadcast an hour of a source meets its turbines in one row: no copy by tile, no tile key."""
    turbines = _random_farm(3, 30, 900.0)
    hours = [(*t, 1, 77.0, 8.0, 0.5, 20.0, 1.2) for t in turbines]
    hours = spark.createDataFrame(hours, FARM + ", ts int, direction double, wind double, thrust double, ta double, rho double")
    tiles = wake.sector_tiles(spark.createDataFrame(turbines, FARM))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = wake.wake_speeds(hours, tiles)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line and "tile_" not in line]
    by_hour = [line for line in dealt if "ts#" in line]
    assert len(by_hour) == 1 and not any("ts#" in line and "tile_" in line for line in plan.splitlines() if "Exchange" in line)

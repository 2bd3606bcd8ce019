"""The registered queries as DuckDB SQL over the driver tables.

``CTES`` holds named building blocks; ``oracle_sql`` puts in front of each final
SELECT the blocks it needs. The SQL forms every pair of turbines and every tower
choice by brute force, so it checks the pruned joins of the Spark operators.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from firmwatt.checks import tables as T

# More solver steps than the operators take: results that had not converged would differ.
POINT_STEPS, HEIGHT_STEPS = 9, 40

# Spellings of the module technology by their code.
TECHNOLOGY_SPELLINGS = {
    "monoSi": ["Mono-c-Si", "monoSi", "monosi", "c-Si", "xsi", "mtSiMono"],
    "multiSi": ["Multi-c-Si", "multiSi", "multisi", "mc-Si", "EFG mc-Si"],
    "poliSi": ["polySi", "polysi", "mtSiPoly"],
    "cis": ["CIS", "cis"],
    "cigs": ["CIGS", "cigs"],
    "cdte": ["CdTe", "cdte", "Thin Film", "GaAs"],
    "amorphous": ["amorphous", "asi", "a-Si / mono-Si", "2-a-Si", "3-a-Si", "Si-Film", "HIT-Si"],
}
TECHNOLOGY_CODES = {x: code for code, found in TECHNOLOGY_SPELLINGS.items() for x in found}

# Perez (1990), one row per clearness bin: lower edge, f11, f12, f13, f21, f22, f23.
PEREZ_BINS = [
    (0.0, -0.008, 0.588, -0.062, -0.060, 0.072, -0.022),
    (1.065, 0.130, 0.683, -0.151, -0.019, 0.066, -0.029),
    (1.23, 0.330, 0.487, -0.221, 0.055, -0.064, -0.026),
    (1.5, 0.568, 0.187, -0.295, 0.109, -0.152, -0.014),
    (1.95, 0.873, -0.392, -0.362, 0.226, -0.462, 0.001),
    (2.8, 1.132, -1.237, -0.412, 0.288, -0.823, 0.056),
    (4.5, 1.060, -1.600, -0.359, 0.264, -1.127, 0.131),
    (6.2, 0.678, -0.327, -0.250, 0.156, -1.377, 0.251),
]


def r(x: str, n: int = 4, name: str | None = None) -> str:
    """Rounded half to even, without a negative zero."""
    text = f"(round_even({x}, {n}) + 0e0)"
    return f"{text} AS {name}" if name else text


def stamp(x: str = "ts") -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS ts"


def great_circle(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))"
    )


def distance(a: str, b: str) -> str:
    """3-D distance in km between two aliases with lat, lon, elev."""
    flat = great_circle(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")
    return f"sqrt(pow({flat}, 2) + pow(({b}.elev - {a}.elev) / 1000, 2))"


def east(lat0: str, lon0: str, lon: str) -> str:
    return f"(sign({lon} - {lon0}) * {great_circle(lat0, lon0, lat0, lon)} * 1000)"


def north(lat0: str, lon0: str, lat: str) -> str:
    return f"(sign({lat} - {lat0}) * {great_circle(lat0, lon0, lat, lon0)} * 1000)"


def poly(x: str, c: list[float]) -> str:
    text = f"({c[-1]}::DOUBLE)"
    for v in reversed(c[:-1]):
        text = f"({text} * {x} + ({v}::DOUBLE))"
    return text


def values(rows: list[tuple]) -> str:
    def one(v) -> str:
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, int):
            return str(v)
        return f"{v!r}::DOUBLE" if np.isfinite(v) else f"'{v}'::DOUBLE"

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def dense_spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Not-a-knot cubics by one dense system over all coefficients."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for i in range(n):
        h = x[i + 1] - x[i]
        a[row, 4 * i], b[row] = 1, y[i]
        a[row + 1, 4 * i : 4 * i + 4], b[row + 1] = [1, h, h**2, h**3], y[i + 1]
        row += 2
    for i in range(n - 1):
        h = x[i + 1] - x[i]
        a[row, 4 * i + 1 : 4 * i + 4] = [1, 2 * h, 3 * h * h]
        a[row, 4 * i + 5] = -1
        a[row + 1, 4 * i + 2 : 4 * i + 4] = [2, 6 * h]
        a[row + 1, 4 * i + 6] = -2
        row += 2
    for left in (0, n - 2):
        a[row, 4 * left + 3], a[row, 4 * left + 7] = 1, -1
        row += 1
    return np.linalg.solve(a, b).reshape(n, 4)


@cache
def segment_rows() -> str:
    """Segments of both models at every density the weather mapping can give."""
    rows = []
    for model in T.MODELS:
        name, v_nom, rho_nom, v_max, scale = model[0], model[4], model[5], model[7], model[10]
        v = np.arange(1.0, 26.0)
        p, ct = np.array(T.CURVE_POWER) * scale, np.array(T.CURVE_THRUST)
        design = v[np.argmax(p / v**3)]
        for rho100 in range(110, 125):
            rho = rho100 / 100
            q = (v - design) / (v_nom - design)
            n = np.where(v < design, 1 / 8, np.where((v > design) & (v <= v_nom), 1 / 8 + (1 / 3 - 1 / 8) * q, 1 / 3))
            x = v if rho == rho_nom else np.minimum(v * (rho_nom / rho) ** n, v_max)
            order = np.argsort(x, kind="stable")
            keep = [i for k, i in enumerate(order) if k == 0 or x[i] != x[order[k - 1]]]
            for quantity, y in (("p", p), ("ct", ct)):
                c = dense_spline(x[keep], y[keep])
                for i in range(len(c)):
                    lo = -np.inf if i == 0 else float(x[keep][i])
                    hi = np.inf if i == len(c) - 1 else float(x[keep][i + 1])
                    rows.append((name, rho, quantity, float(x[keep][i]), lo, hi, *map(float, c[i])))
    return values(rows)


_MODEL_COLUMNS = (
    "model_id, hub, rotor_d, p_nom, v_nom, rho_nom, v_min, v_max, t_min, t_max, scale"
)
_CURVE = [(i, i + 1.0, p, c) for i, (p, c) in enumerate(zip(T.CURVE_POWER, T.CURVE_THRUST))]
_ROSE = "(90e0 - {d}) * pi() / 180"


def _evaluate(speed: str) -> str:
    return f"(s.c0 + ({speed} - s.x0) * (s.c1 + ({speed} - s.x0) * (s.c2 + ({speed} - s.x0) * s.c3)))"


CTES: dict[str, str] = {
    # metered plants
    "mplant": """SELECT s_suppkey AS plant_id, (s_suppkey % 2)::INT AS kind,
        0.2e0 + 0.1e0 * (s_nationkey % 5) AS cen, 10e0 + s_nationkey AS ihf,
        s_nationkey % 2 = 0 AS measured, s_nationkey % 3 = 0 AS offshore,
        20000e0 + 1000e0 * s_nationkey AS ppi_kwh, s_acctbal / 100 AS lat, s_acctbal / 50 AS lon
        FROM supplier""",
    "menergy": "SELECT l_suppkey AS plant_id, l_shipdate AS ts, l_quantity * 1000 AS kwh FROM lineitem",
    "mmonth": """SELECT plant_id, date_trunc('month', ts)::DATE AS month, round_even(sum(kwh), 2) AS s
        FROM menergy GROUP BY ALL""",
    "mspine": """SELECT plant_id, unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 MONTH))::DATE AS month
        FROM (SELECT plant_id, min(month) AS lo, max(month) AS hi FROM mmonth GROUP BY plant_id)""",
    "monthly": """SELECT plant_id, month, coalesce(s, 0e0) AS monthly
        FROM mspine LEFT JOIN mmonth USING (plant_id, month)""",
    "daily": "SELECT *, round_even(monthly / day(last_day(month)), 2) AS daily FROM monthly",
    "lowest": """SELECT plant_id, daily AS lowest, month FROM daily
        QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY daily, month) = 1""",
    "firm_s": """SELECT plant_id, month, measured, CASE WHEN measured
        THEN least(lowest, 12 * cen * (1 - ihf / 100) * 1000) ELSE lowest * 0.8e0 END AS firm
        FROM lowest JOIN mplant USING (plant_id)""",
    "firm_w": """SELECT plant_id, month, measured, least(lowest, 24 * cen * (1 - ihf / 100) * 1000)
        * CASE WHEN measured THEN 1e0 ELSE 0.6e0 END AS firm
        FROM lowest JOIN mplant USING (plant_id)""",
    "window12": """SELECT plant_id, measured, firm, unnest(range(start, start + INTERVAL 12 MONTH,
        INTERVAL 1 MONTH))::DATE AS month FROM (SELECT *, make_date(year(month)
        - CASE WHEN month(month) = 12 THEN 0 ELSE 1 END, 12, 1) AS start FROM firm_s)""",
    "surplus": """SELECT plant_id, month, CASE WHEN measured THEN round_even(daily - firm, 2)
        ELSE 0e0 END AS surplus FROM window12 LEFT JOIN daily USING (plant_id, month)""",
    # readings and weather
    "reading": f"""SELECT event_id, user_id % {T.STATIONS} AS plant_id,
        make_timestamp(year(ts), month(ts), day(ts), hour(ts), 0, 0) AS ts,
        (event_id * 37 % 360) + 0.25e0 AS direction, 990.5e0 + event_id % 25 AS pressure,
        15.5e0 + user_id % 20 AS ta, value AS wind FROM events""",
    "hourly": """SELECT date_trunc('hour', ts) AS ts,
        round_even(avg(sqrt(value)) * (0.6e0 + 0.05e0 * hour(date_trunc('hour', ts))), 6) AS wind,
        (sum(event_id * 37) % 360)::DOUBLE + 0.37e0 AS direction,
        round_even(avg(15 + user_id % 20), 6) AS ta,
        round_even(avg(990 + event_id % 25), 6) AS pressure,
        round_even(avg(value) / 60 * greatest(0e0, 1 - (hour(date_trunc('hour', ts)) - 12e0)
          * (hour(date_trunc('hour', ts)) - 12e0) / 42.25e0), 6) AS ghi_kwh
        FROM events GROUP BY date_trunc('hour', ts)""",
    "weather": f"""SELECT s AS series_id, ts, wind * (0.9e0 + 0.05e0 * s) AS wind,
        direction + 4 * s AS direction, ta + 0.25e0 * s AS ta, pressure + 0.5e0 * s AS pressure,
        ghi_kwh * (0.8e0 + 0.05e0 * s) * 1000 AS ghi
        FROM hourly, range(0, {T.STATIONS}) AS g(s)""",
    "air": """SELECT *, (1e0 / (ta + 273.15e0)) * (pressure * 100 / 287.058e0 - pow(0.0000205e0
        * exp(0.0631846e0 * (ta + 273.15e0)), 2) / (611.2e0 * exp(17.62e0 * ta / (ta + 243.5e0)))
        * (1 / 287.058e0 - 1 / 461.5e0)) AS rho FROM weather""",
    "rho_mean": "SELECT series_id, round_even(avg(rho), 2) AS rho_mean FROM air GROUP BY series_id",
    # farms
    "turb": f"""SELECT plant_id, turbine_id, k AS ordinal,
        CASE WHEN k % 2 = 0 THEN 'M0' ELSE 'M1' END AS model_id,
        12.24e0 + 0.2e0 * (plant_id % 50) + 0.005e0 * (k % 5) + 0.00001e0 * (turbine_id * 7919 % 97) AS lat,
        -71.23e0 + 0.0126e0 * (k // 5) + 0.00001e0 * (turbine_id * 104729 % 89) AS lon,
        30e0 + 2e0 * (k % 4) AS elev, plant_id * 3 + k % 3 AS declared_tower,
        k // 5 AS string_pos, k % 5 AS pos
        FROM (SELECT s_suppkey AS turbine_id, s_suppkey // {T.FARM_SIZE} AS plant_id,
              s_suppkey % {T.FARM_SIZE} AS k FROM supplier)""",
    "farm": f"""SELECT DISTINCT plant_id, 2e0 + plant_id % 10 AS cen, 5e0 + 3 * (plant_id % 7) AS ihf,
        12000000e0 + 1000000e0 * (plant_id % 9) AS ppi, 0.2e0 AS kpc, 0.5e0 AS kt, 0.1e0 AS kin,
        36e0 AS kv, plant_id % 2 = 0 AS measured, plant_id % 3 = 0 AS offshore,
        12.23987e0 + 0.2e0 * (plant_id % 50) AS lat, -71.25036e0 AS lon, 32e0 AS elev,
        plant_id % {T.STATIONS} AS series_id,
        CASE WHEN plant_id % 3 = 0 THEN 0.0002e0 ELSE 0.055e0 END AS z01,
        CASE WHEN plant_id % 3 = 0 THEN 0.03e0 ELSE 0.05e0 END AS z02,
        CASE WHEN plant_id % 3 = 0 THEN 0.04e0 ELSE 0.075e0 END AS cre FROM turb""",
    "tower": f"""SELECT plant_id, plant_id * 3 + t AS tower_id,
        12.24e0 + 0.2e0 * (plant_id % 50) + 0.01e0 * t AS lat, -71.23e0 + 0.0126e0 * t AS lon,
        30e0 + t AS elev, 1.2e0 + 0.4e0 * t AS radius_km, (plant_id + t) % {T.STATIONS} AS series_id
        FROM farm, range(0, 3) AS g(t)""",
    "model": f"SELECT * FROM (VALUES {values(T.MODELS)}) AS m({_MODEL_COLUMNS})",
    "pt": f"""SELECT model_id, idx, v, p * scale AS p, ct FROM model,
        (VALUES {values(_CURVE)}) AS c(idx, v, p, ct)""",
    "tdist": f"""SELECT t.plant_id, t.turbine_id, t.declared_tower, w.tower_id, w.radius_km,
        {distance('w', 't')} AS dist FROM turb t JOIN tower w USING (plant_id)""",
    "nearest": """SELECT plant_id, turbine_id, declared_tower, coalesce(
        max(CASE WHEN tower_id = declared_tower AND dist <= radius_km THEN tower_id END),
        arg_min(tower_id, dist) FILTER (WHERE dist <= radius_km), declared_tower) AS tower_id
        FROM tdist GROUP BY plant_id, turbine_id, declared_tower""",
    "feature": """SELECT turb.*, model.* EXCLUDE (model_id), rotor_d / 2 AS radius,
        pi() * (rotor_d / 2) * (rotor_d / 2) AS area FROM turb JOIN model USING (model_id)""",
    "origin": "SELECT plant_id, lat AS lat0, lon AS lon0, elev AS elev0 FROM turb WHERE ordinal = 0",
    "hop": f"""SELECT a.plant_id, a.string_pos, a.pos, a.turbine_id,
        coalesce(b.turbine_id::VARCHAR, 'pcc') AS next_hop,
        CASE WHEN b.turbine_id IS NULL THEN {distance('a', 'f')} ELSE {distance('a', 'b')} END AS hop_km
        FROM turb a JOIN farm f USING (plant_id) LEFT JOIN turb b ON a.plant_id = b.plant_id
        AND a.string_pos = b.string_pos AND b.pos = a.pos + 1""",
    "cpath": """SELECT plant_id, turbine_id, round_even(sum(hop_km) OVER (PARTITION BY plant_id, string_pos
        ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS path_km FROM hop""",
    "ohm": """SELECT plant_id, avg(ohm) AS mean_ohm FROM (SELECT DISTINCT plant_id, string_pos,
        0.2e0 + 0.01e0 * string_pos AS ohm FROM turb) GROUP BY plant_id""",
    "stat": f"""SELECT t.*, f.measured, f.offshore, f.z01, f.z02, f.cre, f.kv, f.kpc, f.kt, f.kin,
        o.mean_ohm, c.path_km, q.rho_mean, z.series_id,
        {east('g.lat0', 'g.lon0', 't.lon')} AS x_m, {north('g.lat0', 'g.lon0', 't.lat')} AS y_m,
        t.elev - g.elev0 AS dz_m
        FROM feature t JOIN farm f USING (plant_id) JOIN origin g USING (plant_id)
        JOIN ohm o USING (plant_id) JOIN cpath c USING (plant_id, turbine_id)
        JOIN nearest n USING (plant_id, turbine_id)
        JOIN tower w ON w.plant_id = n.plant_id AND w.tower_id = n.tower_id
        CROSS JOIN LATERAL (SELECT CASE WHEN f.measured THEN w.series_id ELSE f.series_id END AS series_id) z
        JOIN rho_mean q ON q.series_id = z.series_id""",
    "th": """SELECT stat.*, a.ts, a.wind, a.direction, a.ta, a.rho FROM stat JOIN air a
        ON a.series_id = stat.series_id""",
    "mdir": "SELECT plant_id, ts, avg(direction) AS mean_dir FROM th GROUP BY plant_id, ts",
    "factor": f"""SELECT m.plant_id, m.ts, s.turbine_id,
        sin({_ROSE.format(d='mean_dir')}) * x_m + cos({_ROSE.format(d='mean_dir')}) * y_m AS factor
        FROM mdir m JOIN stat s USING (plant_id)""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY plant_id, ts ORDER BY factor DESC, turbine_id)
        AS rank FROM factor""",
    "behind": f"""SELECT th.*, b.turbine_id AS lead_id,
        -cos({_ROSE.format(d='th.direction')}) * {east('b.lat', 'b.lon', 'th.lon')}
        - sin({_ROSE.format(d='th.direction')}) * {north('b.lat', 'b.lon', 'th.lat')} AS x_dist
        FROM th JOIN ranked k ON k.plant_id = th.plant_id AND k.ts = th.ts AND k.rank = 1
        JOIN turb b ON b.turbine_id = k.turbine_id
        WHERE th.turbine_id <> k.turbine_id""",
    "ibl": f"""SELECT *, CASE WHEN x_dist > 0 AND 10000 * (ln(10000 / z02) - 1) >= 0.9e0 * x_dist
        THEN list_reduce(list_concat([10000e0], list_transform(range(0, {HEIGHT_STEPS}), lambda i: 0e0)),
          lambda h, i: (h + 0.9e0 * x_dist) / ln(h / z02)) END AS ibl FROM behind""",
    "mhub": "SELECT plant_id, avg(hub) AS mean_hub FROM feature GROUP BY plant_id",
    "hz": """SELECT ibl.*, ibl + 2e0 / 3 * mean_hub AS h, hub - rotor_d / 2 AS z,
        ln((hub - rotor_d / 2) / (0.09e0 * (ibl + 2e0 / 3 * mean_hub))) / ln(0.3e0 / 0.09e0) AS w
        FROM ibl JOIN mhub USING (plant_id)
        WHERE offshore AND x_dist > 0 AND (plant_id, ts) NOT IN
          (SELECT (plant_id, ts) FROM ibl WHERE x_dist > 0 AND ibl IS NULL)""",
    "flat": """SELECT *, CASE
        WHEN z > 0.09e0 * h AND z < 0.3e0 * h THEN wind / ln(z / z01) * (ln(h / z01) / ln(h / z02)
          * ln(0.09e0 * h / z02) * (1 - w) + ln(0.3e0 * h / z01) * w)
        WHEN z < 0.09e0 * h THEN wind * ln(h / z01) * ln(z / z02) / (ln(h / z02) * ln(z / z01))
        ELSE wind END AS flat FROM hz""",
    "corr": """SELECT plant_id, ts, turbine_id, nullif(CASE WHEN x_dist / rotor_d >= 60 THEN wind
        * (1 - (1 - flat / nullif(wind, 0)) * pow(0.5e0, (x_dist - 60 * rotor_d) / (40 * rotor_d)))
        ELSE flat END, wind) AS corrected FROM flat""",
    "free": """SELECT th.* REPLACE (coalesce(c.corrected, th.wind) AS wind) FROM th
        LEFT JOIN corr c USING (plant_id, ts, turbine_id)""",
    "seg": "SELECT * FROM (VALUES {segments}) AS s(model_id, rho_mean, quantity, x0, lo, hi, c0, c1, c2, c3)",
    "src": f"""SELECT free.*, {_evaluate('free.wind')} * rho_nom / rho AS thrust FROM free JOIN seg s
        ON s.model_id = free.model_id AND s.rho_mean = free.rho_mean AND s.quantity = 'ct'
        AND free.wind >= s.lo AND free.wind < s.hi""",
    "pair1": f"""SELECT i.plant_id, i.ts, i.turbine_id, i.x_m - j.x_m AS e, i.y_m - j.y_m AS n,
        i.dz_m - j.dz_m AS dz, j.radius AS t, j.cre, j.wind, j.thrust,
        -cos({_ROSE.format(d='j.direction')}) AS ux, -sin({_ROSE.format(d='j.direction')}) AS uy
        FROM src i JOIN src j ON i.plant_id = j.plant_id AND i.ts = j.ts
        AND i.turbine_id <> j.turbine_id""",
    "pair2": """SELECT *, t + cre * p AS w, sqrt(pow(e - p * ux, 2) + pow(n - p * uy, 2) + dz * dz) AS d
        FROM (SELECT *, e * ux + n * uy AS p FROM pair1) WHERE p > 0""",
    "pair3": """SELECT *, abs((t * t - w * w + d * d) / (2 * nullif(d, 0))) AS d1 FROM pair2""",
    "pair4": """SELECT *, CASE WHEN d >= t + w THEN 0e0
        WHEN d >= w OR (d + t >= w AND d > sqrt(w * w - t * t)) THEN
          t * t * (CASE WHEN d1 <= t THEN acos(d1 / t) ELSE 'nan'::DOUBLE END)
          + w * w * (CASE WHEN abs(d - d1) <= w THEN acos((d - d1) / w) ELSE 'nan'::DOUBLE END)
          - d * sqrt(abs(t * t - d1 * d1))
        WHEN d + t >= w THEN pi() * t * t
          - t * t * (CASE WHEN d1 <= t THEN acos(d1 / t) ELSE 'nan'::DOUBLE END)
          + w * w * (CASE WHEN abs(d - d1) <= w THEN acos((d - d1) / w) ELSE 'nan'::DOUBLE END)
          - d * sqrt(abs(t * t - d1 * d1))
        ELSE pi() * t * t END AS cover FROM pair3""",
    "lost": """SELECT plant_id, ts, turbine_id, sum(CASE WHEN thrust > 1 OR isnan(cover) THEN 0e0
        ELSE cover / (pi() * t * t) * pow(wind * (1 - sqrt(1 - thrust)) * (t / w) * (t / w), 2) END) AS deficit
        FROM pair4 GROUP BY ALL""",
    "calm": "SELECT plant_id, ts, max(thrust) > 1 AS undefined FROM src GROUP BY ALL",
    "wake": """SELECT src.*, greatest(0e0, wind - sqrt(CASE WHEN undefined THEN 0e0
        ELSE coalesce(deficit, 0e0) END)) AS wake_speed
        FROM src JOIN calm USING (plant_id, ts) LEFT JOIN lost USING (plant_id, ts, turbine_id)""",
    "curvep": f"""SELECT wake.*, CASE WHEN ta < t_min OR ta > t_max THEN 0e0
        ELSE {_evaluate('wake_speed')} END * rho_nom / rho AS p0 FROM wake JOIN seg s
        ON s.model_id = wake.model_id AND s.rho_mean = wake.rho_mean AND s.quantity = 'p'
        AND wake_speed >= s.lo AND wake_speed < s.hi""",
    "power": """SELECT *, greatest(0e0, least(p_nom, (p0 * 1000 - pow(p0 * 1000 / (kv * 1000), 2)
        * (mean_ohm * path_km)) / 1000 * (1 - kpc / 100 - kt / 100 - kin / 100))) AS power FROM curvep""",
    "windh": """SELECT plant_id, ts, least(sum(power), any_value(ppi) / 1000) AS kwh FROM power
        JOIN farm USING (plant_id) GROUP BY plant_id, ts""",
    "ownpt": """SELECT turbine_id, idx, v, p * (1 + 0.002e0 * (turbine_id % 7) * idx) AS p
        FROM turb JOIN pt USING (model_id)""",
    "dspeed": """SELECT model_id, arg_max(v, p / pow(v, 3)) AS v_design FROM pt GROUP BY model_id""",
    "ccurve": """SELECT model_id, rho_mean, idx, v, v_design,
        CASE WHEN rho_nom = rho_mean THEN v ELSE least(v_max, v * pow(rho_nom / rho_mean,
          CASE WHEN v < v_design THEN 1e0 / 3 WHEN v > v_design AND v <= v_nom
          THEN 1e0 / 3 + (v - v_design) / (v_nom - v_design) / 3 ELSE 2e0 / 3 END)) END AS vp,
        CASE WHEN rho_nom = rho_mean THEN v ELSE least(v_max, v * pow(rho_nom / rho_mean,
          CASE WHEN v < v_design THEN 1e0 / 8 WHEN v > v_design AND v <= v_nom
          THEN 1e0 / 8 + (1e0 / 3 - 1e0 / 8) * (v - v_design) / (v_nom - v_design)
          ELSE 1e0 / 3 END)) END AS vcth
        FROM (SELECT DISTINCT model_id, rho_mean, rho_nom, v_nom, v_max FROM stat)
        JOIN dspeed USING (model_id) JOIN pt USING (model_id)""",
    # solar
    "inv": """SELECT s_suppkey AS inverter_id, s_suppkey // 4 AS plant_id, 1 + s_nationkey % 3 AS n_inv,
        0.5e0 + 0.125e0 * (s_suppkey % 8) AS scale, 200000e0 * (0.5e0 + 0.125e0 * (s_suppkey % 8)) AS paco,
        202507.04e0 * (0.5e0 + 0.125e0 * (s_suppkey % 8)) AS pdco, 1174e0 AS vdco,
        2025.07e0 * (0.5e0 + 0.125e0 * (s_suppkey % 8)) AS pso, 3.3e0 AS pnt FROM supplier""",
    "site": f"""SELECT DISTINCT plant_id, 4.6454e0 + 0.05e0 * (plant_id % 60) AS lat,
        -74.06604e0 + 0.02e0 * (plant_id % 40) AS lon, 0.17e0 + 0.01e0 * (plant_id % 5) AS albedo,
        14.6e0 AS l_pct, 0.2e0 + 0.1e0 * (plant_id % 4) AS cen, 5e0 + plant_id % 20 AS ihf,
        500000e0 + 10000e0 * (plant_id % 30) AS ppi, 0.5e0 AS kpc, 0.25e0 AS kt, 0.125e0 AS kin,
        plant_id % 2 = 0 AS measured, plant_id % {T.STATIONS} AS series_id FROM inv""",
    "arr": """SELECT plant_id, inverter_id, g.a AS array_id, inverter_id % 2 = 0 AS tracker,
        108e0 + 10 * g.a + inverter_id % 7 AS axis_az, 4e0 + 3 * g.a AS axis_tilt, 55e0 AS max_angle,
        26 - g.a AS modules_per_string, 17 + inverter_id % 3 AS strings,
        inverter_id % 3 = 0 AS bifacial, 14.25e0 + 0.01e0 * (inverter_id % 10) AS il_ref
        FROM inv, range(0, 2) AS g(a)""",
    "sser": """SELECT s.plant_id, w.ts, w.ghi, w.ta, w.ghi * 0.15e0 AS poa_back, s.lat, s.lon
        FROM weather w JOIN site s USING (series_id)""",
    "sun1": """SELECT *, hour(u) + minute(u) / 60e0 + second(u) / 3600e0 AS hh,
        date_diff('day', DATE '2000-01-01', u::DATE) + (hour(u) + minute(u) / 60e0 + second(u) / 3600e0) / 24
        - 0.5e0 AS n FROM (SELECT *, ts + INTERVAL 5 HOUR AS u FROM sser)""",
    "sun2": """SELECT *, 2.1429e0 - 0.0010394594e0 * n AS om, 4.8950630e0 + 0.017202791698e0 * n AS ml,
        6.2400600e0 + 0.0172019699e0 * n AS g FROM sun1""",
    "sun3": """SELECT *, ml + 0.03341607e0 * sin(g) + 0.00034894e0 * sin(2 * g) - 0.0001134e0
        - 0.0000203e0 * sin(om) AS lam, 0.4090928e0 - 6.2140e-9 * n + 0.0000396e0 * cos(om) AS ep,
        radians(lat) AS phi FROM sun2""",
    "sun4": """SELECT *, asin(sin(ep) * sin(lam)) AS dec, radians((6.6974243242e0 + 0.0657098283e0 * n + hh)
        * 15 + lon) - atan2(cos(ep) * sin(lam), cos(lam)) AS ha FROM sun3""",
    "sun5": """SELECT *, acos(least(1e0, greatest(-1e0, cos(phi) * cos(ha) * cos(dec) + sin(dec) * sin(phi)))) AS zz,
        degrees(atan2(-sin(ha), tan(dec) * cos(phi) - sin(phi) * cos(ha))) AS azd FROM sun4""",
    "sun": """SELECT plant_id, ts, ghi, ta, poa_back, lat, lon,
        degrees(zz + 6371.01e0 / 149597890e0 * sin(zz)) AS zenith,
        CASE WHEN azd < 0 THEN azd + 360 ELSE azd END AS azimuth FROM sun5""",
    "ext": """SELECT *, 1.00011e0 + 0.034221e0 * cos(b) + 0.00128e0 * sin(b) + 0.000719e0 * cos(2 * b)
        + 0.000077e0 * sin(2 * b) AS orb FROM (SELECT *, 2 * pi() * (dayofyear(ts) - 1) / 365 AS b FROM sun)""",
    "disc1": """SELECT *, 1366.1e0 * orb AS iext, least(1e0, greatest(0e0, ghi / (1370e0 * orb
        * greatest(0.065e0, cos(radians(zenith)))))) AS kt, CASE WHEN zenith <= 90 THEN least(12e0,
        1 / (cos(radians(zenith)) + 0.15e0 * pow(93.885e0 - zenith, -1.253e0))) END AS am FROM ext""",
    "disc2": f"""SELECT *, 1370e0 * orb * ({poly('am', [0.866, -0.122, 0.0121, -0.000653, 0.000014])}
        - (CASE WHEN kt <= 0.6 THEN {poly('kt', [0.512, -1.56, 2.286, -2.222])}
             ELSE {poly('kt', [-5.743, 21.77, -27.49, 11.56])} END
         + CASE WHEN kt <= 0.6 THEN {poly('kt', [0.37, 0.962])}
             ELSE {poly('kt', [41.4, -118.5, 66.05, 31.9])} END
         * exp(am * CASE WHEN kt <= 0.6 THEN {poly('kt', [-0.28, 0.932, -2.048])}
             ELSE {poly('kt', [-47.01, 184.2, -222.0, 73.81])} END))) AS raw FROM disc1""",
    "disc": """SELECT *, CASE WHEN zenith > 87 OR ghi < 0 OR raw < 0 THEN 0e0 ELSE raw END AS dni0,
        coalesce(am, 0e0) AS airmass FROM disc2""",
    "clos": """SELECT *, CASE WHEN zenith > 87 THEN 0e0 ELSE dni0 END AS dni1,
        CASE WHEN zenith > 87 THEN 0e0 ELSE ghi - dni0 * cos(radians(zenith)) END AS dhi1 FROM disc""",
    "irr": """SELECT *, CASE WHEN dni1 <= 0 AND dhi1 < 0 THEN 0e0 ELSE dni1 END AS dni,
        CASE WHEN dni1 <= 0 AND dhi1 < 0 THEN 0e0 ELSE dhi1 END AS dhi,
        ts::TIME BETWEEN TIME '06:00:00' AND TIME '18:00:00' AS day FROM clos""",
    "ori1": """SELECT i.*, a.* EXCLUDE (plant_id), s.albedo, s.l_pct,
        atan2(sin(radians(zenith)) * sin(radians(azimuth)) * cos(radians(axis_az))
          - sin(radians(zenith)) * cos(radians(azimuth)) * sin(radians(axis_az)),
          (sin(radians(zenith)) * sin(radians(azimuth)) * sin(radians(axis_az))
          + sin(radians(zenith)) * cos(radians(azimuth)) * cos(radians(axis_az))) * sin(radians(axis_tilt))
          + cos(radians(zenith)) * cos(radians(axis_tilt))) AS ideal
        FROM irr i JOIN arr a USING (plant_id) JOIN site s USING (plant_id)""",
    "ori2": """SELECT *, greatest(-radians(max_angle), least(radians(max_angle), ideal - CASE
        WHEN abs(cos(ideal)) * 3.5e0 < 1 THEN sign(ideal) * acos(abs(cos(ideal)) / (2e0 / 7)) ELSE 0 END)) AS turn
        FROM ori1""",
    "ori": """SELECT *, CASE WHEN tracker THEN degrees(acos(cos(turn) * cos(radians(axis_tilt))))
        ELSE axis_tilt END AS tilt, CASE WHEN tracker THEN axis_az + degrees(atan2(sin(turn),
        cos(turn) * sin(radians(axis_tilt)))) ELSE axis_az END AS saz FROM ori2""",
    "per1": """SELECT *, greatest(0e0, cos(radians(tilt)) * cos(radians(zenith)) + sin(radians(tilt))
        * sin(radians(zenith)) * cos(radians(azimuth - saz))) AS facing,
        ((dhi + dni) / nullif(dhi, 0) + 1.041e0 * pow(radians(zenith), 3))
        / (1 + 1.041e0 * pow(radians(zenith), 3)) AS eps, dhi * airmass / iext AS delta FROM ori""",
    "bins": f"""SELECT *, lead(lo, 1, 'inf'::DOUBLE) OVER (ORDER BY lo) AS hi FROM
        (VALUES {values(PEREZ_BINS)}) AS b(lo, f11, f12, f13, f21, f22, f23)""",
    "per2": """SELECT p.*, greatest(0e0, f11 + f12 * delta + f13 * radians(zenith)) AS f1,
        f21 + f22 * delta + f23 * radians(zenith) AS f2, b.lo FROM per1 p
        LEFT JOIN bins b ON p.eps >= b.lo AND p.eps < b.hi""",
    "per3": """SELECT *, dni * facing AS beam, CASE WHEN dhi = 0 THEN 0e0 WHEN lo IS NOT NULL THEN greatest(0e0,
        dhi * (0.5e0 * (1 - f1) * (1 + cos(radians(tilt))) + f1 * facing
        / greatest(cos(radians(85e0)), cos(radians(zenith))) + f2 * sin(radians(tilt)))) END AS sky,
        ghi * albedo * (1 - cos(radians(tilt))) / 2 AS ground FROM per2""",
    "plane": """SELECT *, beam + sky + ground AS front, CASE WHEN bifacial
        THEN beam + sky + ground + poa_back * 0.7e0 ELSE beam + sky + ground END AS faces FROM per3""",
    "poa": """SELECT * EXCLUDE (faces), CASE WHEN day AND (dni <> 0 OR dhi <> 0) AND NOT isnan(faces)
        THEN faces ELSE 0e0 END AS poa FROM plane""",
    "ptemp": "SELECT *, ta + (45e0 - 20) / 800 * coalesce(poa, 0e0) AS temp FROM poa",
    "circ": """SELECT * REPLACE (coalesce(poa, 0e0) AS poa), coalesce(poa, 0e0) / 1000
        * (il_ref + 0.05e0 * (1 - 6e0 / 100) * (temp - 25)) AS il,
        2.2e-11 * pow((temp + 273.15e0) / 298.15e0, 3) * exp(1.121e0 / (8.617332478e-05 * 298.15e0)
          - 1.121e0 * (1 - 0.0002677e0 * (temp - 25)) / (8.617332478e-05 * (temp + 273.15e0))) AS i0,
        0.22e0 AS rs, CASE WHEN poa > 0 THEN 400e0 * 1000 / poa END AS rsh,
        1.85e0 * (temp + 273.15e0) / 298.15e0 AS a FROM ptemp""",
}


def _solver_ctes() -> None:
    """Newton steps for the characteristic points, one block per step."""
    i = "(il - i0 * (exp({u} / a) - 1) - {u} / rsh)"
    d = "(-(i0 / a) * exp({u} / a) - 1 / rsh)"
    c = "(-(i0 / (a * a)) * exp({u} / a))"

    def at(u: str, target: str) -> str:
        return f"{u} - ({u} - rs * {i.format(u=u)} - {target}) / (1 - rs * {d.format(u=u)})"

    CTES["mp0"] = """SELECT *, top - a * ln(greatest(0e0, top - 4 * a - 2 * il * rs) / a + 1) AS up,
        top AS uo, il * rs AS us FROM (SELECT *, CASE WHEN il > 0 AND rsh IS NOT NULL
        THEN least(a * ln(il / i0 + 1), il * rsh) END AS top FROM circ)"""
    iu, du, cu = i.format(u="up"), d.format(u="up"), c.format(u="up")
    for k in range(POINT_STEPS):
        CTES[f"mp{k + 1}"] = f"""SELECT * REPLACE (
            up - ({du} * (up - {iu} * rs) + {iu} * (1 - {du} * rs)) / ({cu} * (up - {iu} * rs)
              + 2 * {du} * (1 - {du} * rs) - {iu} * {cu} * rs) AS up,
            uo - {i.format(u='uo')} / {d.format(u='uo')} AS uo, {at('us', '0')} AS us) FROM mp{k}"""
    CTES["mx0"] = f"""SELECT *, least(uo, uo / 2 + il * rs) AS ux, least(uo, (uo + vm) / 2 + il * rs) AS uxx
        FROM (SELECT *, {iu} AS im, up - {iu} * rs AS vm FROM mp{POINT_STEPS})"""
    for k in range(POINT_STEPS):
        CTES[f"mx{k + 1}"] = f"""SELECT * REPLACE ({at('ux', '(uo / 2)')} AS ux,
            {at('uxx', '((uo + vm) / 2)')} AS uxx) FROM mx{k}"""
    CTES["mpp"] = f"""SELECT *, coalesce({i.format(u='us')}, 0) AS i_sc, coalesce(uo, 0) AS v_oc,
        coalesce(im, 0) AS i_mp, coalesce(vm, 0) AS v_mp, coalesce(im * vm, 0) AS p_mp,
        coalesce({i.format(u='ux')}, 0) AS i_x, coalesce({i.format(u='uxx')}, 0) AS i_xx
        FROM mx{POINT_STEPS}"""


_solver_ctes()

CTES |= {
    "strs": """SELECT * REPLACE (i_sc * strings AS i_sc, i_mp * strings AS i_mp, i_x * strings AS i_x,
        i_xx * strings AS i_xx, v_oc * modules_per_string AS v_oc, v_mp * modules_per_string AS v_mp,
        p_mp * modules_per_string * strings AS p_mp) FROM mpp""",
    "dclost": """SELECT * REPLACE (i_mp * (1 - 10e0 / 100) * (1 - l_pct / 100) AS i_mp,
        p_mp * (1 - 10e0 / 100) * (1 - l_pct / 100) AS p_mp) FROM strs""",
    "samp": f"""SELECT inverter_id, vdco, paco, n // 7 AS lev, dc0 * scale AS dc, ac0 * scale AS ac
        FROM inv, (VALUES {values([(k, a, b) for k, (a, b) in enumerate(zip(T.INVERTER_DC, T.INVERTER_AC))])})
        AS q(n, dc0, ac0)""",
    "lsum": """SELECT inverter_id, lev, vdco, paco, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3,
        sum(x * x * x * x) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2, count(*) * 1e0 AS s0
        FROM (SELECT *, dc / paco AS x, ac / paco AS y FROM samp) GROUP BY ALL""",
    "lfit": """SELECT *, (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS qa,
        (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det AS qb,
        (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS qc
        FROM (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det
        FROM lsum)""",
    "lvl": """SELECT inverter_id, qa / paco AS c0l, paco * (-qb + sqrt(qb * qb - 4 * qa * (qc - 1))) / (2 * qa) AS pd,
        paco * (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS ps,
        CASE lev WHEN 0 THEN 9.93e0 + (0.874e0 - 1e0) * vdco WHEN 1 THEN 0e0
        ELSE 66.45e0 + (1.123e0 - 1e0) * vdco END AS dv FROM lfit""",
    "ifit": """SELECT inverter_id, regr_intercept(c0l, dv) AS c0, regr_slope(pd, dv) / regr_intercept(pd, dv) AS c1,
        regr_slope(ps, dv) / regr_intercept(ps, dv) AS c2, regr_slope(c0l, dv) / regr_intercept(c0l, dv) AS c3
        FROM lvl GROUP BY inverter_id""",
    "ac1": """SELECT v.plant_id, d.inverter_id, d.ts, d.p_mp, v.n_inv, v.pso AS start, v.pnt, v.paco,
        sum(d.p_mp) OVER (PARTITION BY d.inverter_id, d.ts) AS pdc,
        v.pdco * (1 + c1 * (v_mp - vdco)) AS aa, v.pso * (1 + c2 * (v_mp - vdco)) AS bb,
        c0 * (1 + c3 * (v_mp - vdco)) AS cc
        FROM dclost d JOIN inv v ON v.inverter_id = d.inverter_id JOIN ifit f ON f.inverter_id = d.inverter_id""",
    "ac": """SELECT plant_id, inverter_id, ts, n_inv * greatest(0e0, CASE WHEN pdc < start THEN -abs(pnt)
        ELSE least(paco, sum(p_mp / nullif(pdc, 0) * ((paco / (aa - bb) - cc * (aa - bb)) * (pdc - bb)
        + cc * (pdc - bb) * (pdc - bb)))) END) AS p_ac FROM ac1
        GROUP BY plant_id, inverter_id, ts, n_inv, pdc, start, pnt, paco""",
    "sol": "SELECT plant_id, ts, round_even(sum(p_ac) / 1000, 2) AS kwh FROM ac GROUP BY plant_id, ts",
    "solh": """SELECT plant_id, ts, least(kwh * (1 - kpc / 100) * (1 - kt / 100) * (1 - kin / 100)
        * (1 - ihf / 100), ppi / 1000) AS kwh FROM sol JOIN site USING (plant_id)""",
}


def _plant_result(hours: str, plants: str, hours_a_day: int, reduced: str) -> str:
    """Firm energy and surplus from an hourly table, as one SELECT."""
    return f"""
        , pm AS (SELECT plant_id, date_trunc('month', ts)::DATE AS month,
            round_even(sum(kwh), 2) AS monthly FROM {hours} GROUP BY ALL),
        pd AS (SELECT *, round_even(monthly / day(last_day(month)), 2) AS daily FROM pm),
        pf AS (SELECT plant_id, month, measured, {reduced} AS firm FROM
            (SELECT plant_id, min(daily) AS lowest, arg_min(month, (daily, month)) AS month
             FROM pd GROUP BY plant_id) JOIN
            (SELECT *, {hours_a_day} * cen * (1 - ihf / 100) * 1000 AS cap FROM {plants}) USING (plant_id)),
        px AS (SELECT plant_id, measured, firm, month, make_date(year(month)
            - CASE WHEN month(month) = 12 THEN 0 ELSE 1 END, 12, 1) AS start FROM pf),
        ps AS (SELECT plant_id, measured, firm, px.month AS firm_month, unnest(range(start,
            start + INTERVAL 12 MONTH, INTERVAL 1 MONTH))::DATE AS month FROM px)
        SELECT plant_id, year(month) AS year, month(month) AS month, round_even(firm, 0)::BIGINT AS firm_kwh_day,
          {r('CASE WHEN measured THEN daily - firm ELSE 0e0 END', 2, 'surplus')},
          {r('monthly', 2, 'monthly')}
        FROM ps LEFT JOIN pd USING (plant_id, month)"""


def _finals() -> dict[str, str]:
    ym = "year(month) AS year, month(month) AS month"
    codes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TECHNOLOGY_CODES.items())
    spellings = ", ".join(f"'{k}'" for k in [*TECHNOLOGY_CODES, "unknown"])
    key = f"plant_id, turbine_id, {stamp()}"
    akey = f"inverter_id, array_id, {stamp()}"
    skey = f"plant_id, {stamp()}"
    reading = (
        f"event_id, {stamp()}, {r('direction', 4, 'direction')}, {r('pressure', 4, 'pressure')},"
        f" {r('ta', 4, 'ta')}, {r('wind', 4, 'wind')}"
    )
    firm = f"plant_id, {ym}, {r('firm', 4, 'firm')}"
    route = "CASE s_nationkey % 3 WHEN 0 THEN 'solar' WHEN 1 THEN 'wind' ELSE 'rejected' END"
    return {
        "scan_series": f"SELECT plant_id, {reading} FROM reading",
        "scan_towers": f"""SELECT w.plant_id, tower_id, {reading} FROM reading d
            JOIN tower w ON w.series_id = d.plant_id""",
        "series_files": f"""SELECT plant_id, 'station=' || plant_id || '.parquet' AS series_file, NULL AS problem,
              count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first,
              strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, {r('max(wind)', 4, 'top')}
            FROM reading GROUP BY plant_id
            UNION ALL SELECT DISTINCT plant_id, 'station=' || plant_id || '-b.parquet', 'missing', NULL, NULL, NULL, NULL
            FROM reading WHERE plant_id % 3 = 0
            UNION ALL SELECT DISTINCT plant_id, 'half.parquet', 'unreadable', NULL, NULL, NULL, NULL
            FROM reading WHERE plant_id = (SELECT max(plant_id) FROM reading)""",
        "config_to_dims": f"""SELECT plant_id, 'turbine' AS dim, turbine_id::VARCHAR AS item, {r('lat', 6, 'value')} FROM turb
            UNION ALL SELECT plant_id, 'tower', tower_id::VARCHAR, {r('radius_km', 6)} FROM tower
            UNION ALL SELECT plant_id, 'point', concat(model_id, ':', idx), {r('p', 6)}
              FROM (SELECT DISTINCT plant_id, model_id FROM turb) JOIN pt USING (model_id)
            UNION ALL SELECT plant_id, 'link', concat(string_pos, ':', pos, ':', turbine_id),
              {r('0.2e0 + 0.01e0 * string_pos', 6)} FROM turb
            UNION ALL SELECT plant_id, 'plant', 'cen', {r('cen', 6)} FROM farm""",
        "dispatch_by_type": """SELECT s_suppkey AS plant_id, CASE s_nationkey % 3 WHEN 0 THEN 'solar'
            WHEN 1 THEN 'wind' ELSE 'rejected' END AS route, CASE s_nationkey % 3 WHEN 2
            THEN 'unknown plant kind' ELSE 'ok' END AS message FROM supplier""",
        "write_result_tables": """SELECT 'hourly' AS result, count(*) AS rows FROM menergy
            UNION ALL SELECT 'monthly', count(*) FROM monthly UNION ALL SELECT 'daily', count(*) FROM daily
            UNION ALL SELECT 'firm', count(*) FROM firm_s UNION ALL SELECT 'surplus', count(*) FROM surplus""",
        "write_csv": f"SELECT plant_id, {ym}, {r('monthly', 2, 'energy_kwh_month')} FROM monthly",
        "stream_to_dims": f"""SELECT plant_id, 'turbine' AS dim, turbine_id::VARCHAR AS item, {r('lat', 6, 'value')} FROM turb
            UNION ALL SELECT plant_id, 'tower', tower_id::VARCHAR, {r('radius_km', 6)} FROM tower
            UNION ALL SELECT plant_id, 'point', concat(model_id, ':', idx), {r('p', 6)}
              FROM (SELECT DISTINCT plant_id, model_id FROM turb) JOIN pt USING (model_id)
            UNION ALL SELECT plant_id, 'link', concat(string_pos, ':', pos, ':', turbine_id),
              {r('0.2e0 + 0.01e0 * string_pos', 6)} FROM turb
            UNION ALL SELECT plant_id, 'plant', 'cen', {r('cen', 6)} FROM farm
            UNION ALL SELECT DISTINCT s_suppkey // 4, 'solar plant', 'America/Bogota', {r('0.2e0 + 0.1e0 * ((s_suppkey // 4) % 4)', 6)}
              FROM supplier
            UNION ALL SELECT s_suppkey // 4, 'inverter', (s_suppkey % 4)::VARCHAR,
              {r('200000e0 * (0.5e0 + 0.125e0 * (s_suppkey % 8))', 6)} FROM supplier
            UNION ALL SELECT s_suppkey // 4, 'module', concat(s_suppkey % 4, ':module-', s_suppkey), 45e0 FROM supplier
            UNION ALL SELECT s_suppkey // 4, 'array', concat(s_suppkey % 4, ':', a), {r('108e0 + 10 * a + s_suppkey % 7', 6)}
              FROM supplier, unnest([0, 1]) AS t(a)
            UNION ALL SELECT s_suppkey, 'dead letter', CASE s_nationkey % 3 WHEN 2 THEN 'unknown plant kind'
              ELSE 'request cannot be read' END, 1e0 FROM supplier""",
        "ingest_requests_stream": f"""SELECT s_suppkey AS plant_id, (s_nationkey % 3)::INT AS "TipoMensaje",
            concat('{{"ArchivoSeries":{{"Nombre":"', s_name, '"}}}}') AS "CuerpoMensaje", {route} AS route FROM supplier""",
        "request_status": """SELECT s_suppkey AS plant_id, 'request' AS task, CASE s_nationkey % 3
            WHEN 2 THEN 'unknown plant kind' ELSE 'request cannot be read' END AS message, 1 AS n_bad FROM supplier""",
        "accepted_plants": """SELECT plant_id FROM mplant
            WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""",
        "result_payload": """SELECT plant_id, concat('{"ArchivoResultados":"results/', plant_id,
            '","ArchivosResultados":["results/', plant_id, '"],"DatosEnficc":[{"Anio":', year(f.month), ',"Mes":',
            month(f.month), ',"Valor":', round_even(firm, 0)::BIGINT, '}],"DatosEda":[', e.eda,
            '],"IdTransaccion":"run-', plant_id, '","CalculoCorrecto":true}') AS payload
            FROM firm_s f JOIN (SELECT plant_id, string_agg(concat('{"Anio":', year(month), ',"Mes":', month(month),
            ',"Valor":"', coalesce(surplus::DECIMAL(18, 2)::VARCHAR, 'N/A'), '"}'), ',' ORDER BY month) AS eda
            FROM surplus GROUP BY plant_id) e USING (plant_id)""",
        "failure_payload": """SELECT plant_id, concat('{"ArchivoResultados":"","ArchivosResultados":[],',
            '"DatosEnficc":[],"DatosEda":[],"IdTransaccion":"run-', plant_id,
            '","CalculoCorrecto":false,"ExcepcionPython":"latitude or longitude out of range"}') AS payload
            FROM mplant WHERE NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)""",
        "plant_status": """SELECT plant_id, 'pressure' AS task, 'atmospheric pressure out of range' AS message,
            count(*) FILTER (pressure * 3 >= 3000) AS n_bad
            FROM reading GROUP BY plant_id UNION ALL
            SELECT plant_id, 'duplicates', 'repeated time stamp', count(*) FILTER (c > 1) FROM (SELECT plant_id, ts, count(*) AS c
            FROM reading GROUP BY ALL) GROUP BY plant_id UNION ALL
            SELECT plant_id, 'nulls', 'missing value in wind, ta', count(*) FILTER (wind IS NULL OR ta IS NULL) FROM reading GROUP BY plant_id""",
        "parse_decimal_comma": f"SELECT event_id, {r('value', 6, 'value')} FROM events",
        "build_timestamp": f"""SELECT event_id, {stamp("date_trunc('hour', ts)")},
            strftime(date_trunc('hour', ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS ts_utc FROM events""",
        "scale_ghi": f"SELECT event_id, {r('value * 1000', 4, 'ghi')} FROM events",
        "daylight_filter": f"""SELECT event_id, {stamp()} FROM events
            WHERE ts::TIME >= TIME '06:00:00' AND ts::TIME <= TIME '18:00:00'""",
        "drop_dark_rows": f"SELECT {skey}, {r('dni', 6, 'dni')}, {r('dhi', 6, 'dhi')} FROM irr WHERE dni <> 0 OR dhi <> 0",
        "low_sun_clamp": f"SELECT {skey}, {r('dni', 6, 'dni')}, {r('dhi', 6, 'dhi')} FROM irr",
        "cap_interconnection": f"""SELECT plant_id, l_orderkey, l_linenumber, {r('least(kwh, ppi_kwh)', 4, 'kwh')}
            FROM (SELECT l_suppkey AS plant_id, l_orderkey, l_linenumber, l_quantity * 1000 AS kwh FROM lineitem)
            JOIN mplant USING (plant_id)""",
        "floor_zero": f"SELECT event_id, {r('greatest(value - 10, 0e0)', 4, 'value')} FROM events",
        "temperature_gate": f"""SELECT event_id, {r('''CASE WHEN 15 + user_id % 20 < 18 OR 15 + user_id % 20 > 30
            THEN 0e0 ELSE value END''', 4, 'power')} FROM events""",
        "normalize_technology": f"""SELECT p_partkey, technology, CASE technology {codes} END AS tech_code FROM
            (SELECT p_partkey, ([{spellings}])[1 + p_partkey % {len(TECHNOLOGY_CODES) + 1}] AS technology FROM part)""",
        "check_pressure": """SELECT plant_id, 'pressure' AS task, count(*) FILTER (pressure * 3 >= 3000) AS n_bad
            FROM reading GROUP BY plant_id""",
        "check_coordinates": """SELECT plant_id, 'coordinates' AS task,
            count(*) FILTER (NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)) AS n_bad
            FROM mplant GROUP BY plant_id""",
        "check_nulls": """SELECT plant_id, 'nulls' AS task, count(*) FILTER (wind > 100 OR ta IS NULL) AS n_bad
            FROM reading GROUP BY plant_id""",
        "check_inverter_fit": """SELECT plant_id, 'inverter_fit' AS task, count(*) FILTER (c0 IS NULL OR c1 IS NULL
            OR c2 IS NULL OR c3 IS NULL) AS n_bad FROM ifit JOIN inv USING (inverter_id) GROUP BY plant_id""",
        "terrain_constants": "SELECT plant_id, CASE WHEN offshore THEN 0.0002e0 ELSE 0.055e0 END AS z01,"
            " CASE WHEN offshore THEN 0.03e0 ELSE 0.05e0 END AS z02,"
            " CASE WHEN offshore THEN 0.04e0 ELSE 0.075e0 END AS cre FROM mplant",
        "air_density": f"SELECT series_id, {stamp()}, {r('rho', 8, 'rho')} FROM air",
        "geo_distance": f"""SELECT a.turbine_id, {r(great_circle('a.lat', 'a.lon', 'f.lat', 'f.lon'), 6, 'flat_km')},
            {r(distance('a', 'f'), 6, 'dist_km')} FROM turb a JOIN farm f USING (plant_id)""",
        "align_series": f"""SELECT {skey}, {r('zenith', 4, 'zenith')}, {r('iext', 6, 'iext')}, {r('ghi', 6, 'ghi')}
            FROM disc1""",
        "restore_index": f"""SELECT {skey}, {r('ta', 4, 'ta')}, {r('''CASE WHEN day AND (dni <> 0 OR dhi <> 0)
            THEN dhi ELSE 0e0 END''', 6, 'dhi')} FROM irr""",
        "nearest_tower": "SELECT plant_id, turbine_id, declared_tower, tower_id FROM nearest",
        "turbine_features": f"SELECT turbine_id, model_id, hub, radius, {r('area', 6, 'area')} FROM feature",
        "fanout_series": f"SELECT {key}, {r('wind', 8, 'wind')}, {r('direction', 6, 'direction')} FROM th",
        "pair_offsets": f"""SELECT plant_id, turbine_id, {r('x_m', 4, 'x_m')}, {r('y_m', 4, 'y_m')},
            {r('dz_m', 4, 'dz_m')} FROM stat""",
        "curve_lookup": f"""SELECT {key}, {r(_evaluate('th.wind'), 4, 'curve_power')} FROM th JOIN seg s
            ON s.model_id = th.model_id AND s.rho_mean = th.rho_mean AND s.quantity = 'p'
            AND th.wind >= s.lo AND th.wind < s.hi""",
        "series_matrix": """SELECT plant_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
            string_agg((round_even(wind * 1000, 0)::BIGINT)::VARCHAR, ',' ORDER BY turbine_id) AS row FROM th GROUP BY ALL""",
        "matrix_to_long": f"SELECT {key}, {r('wind', 8, 'wind')} FROM th",
        "apply_corrections": f"SELECT {key}, {r('wind', 8, 'wind')} FROM free WHERE offshore",
        "hourly_energy_solar": f"SELECT {skey}, {r('kwh', 2, 'kwh')} FROM sol",
        "hourly_energy_wind": f"SELECT {skey}, {r('kwh', 4, 'kwh')} FROM windh",
        "monthly_energy": f"SELECT plant_id, {ym}, {r('monthly', 2, 'monthly')} FROM monthly",
        "daily_equivalent": f"SELECT plant_id, {ym}, {r('daily', 2, 'daily')} FROM daily",
        "firm_energy_solar": f"SELECT {firm} FROM firm_s",
        "firm_energy_wind": f"SELECT {firm} FROM firm_w",
        "daily_surplus": f"SELECT plant_id, {ym}, {r('surplus', 2, 'surplus')} FROM surplus",
        "mean_density": "SELECT series_id, rho_mean FROM rho_mean",
        "mean_resistance": f"SELECT plant_id, {r('mean_ohm', 6, 'mean_ohm')} FROM ohm",
        "mean_hub_height": f"SELECT plant_id, {r('mean_hub', 6, 'mean_hub')} FROM mhub",
        "mean_direction": f"SELECT {skey}, {r('mean_dir', 6, 'mean_dir')} FROM mdir",
        "design_speed": """SELECT turbine_id, coalesce(arg_max(v, p / pow(v, 3)), 0) AS v_design FROM ownpt
            GROUP BY turbine_id""",
        "distinct_timestamps": f"SELECT DISTINCT plant_id, {stamp()} FROM reading",
        "inverter_fit": f"""SELECT inverter_id, {r('c0 * 1e12', 4, 'c0_e12')}, {r('c1 * 1e6', 4, 'c1_e6')},
            {r('c2 * 1e6', 3, 'c2_e6')}, {r('c3 * 1e3', 4, 'c3_e3')} FROM ifit""",
        "upwind_rank": f"SELECT {key}, {r('factor', 4, 'factor')}, rank FROM ranked",
        "lead_turbine": f"SELECT {skey}, turbine_id AS lead_id FROM ranked WHERE rank = 1",
        "cable_hops": f"SELECT plant_id, string_pos, pos, turbine_id, next_hop, {r('hop_km', 6, 'hop_km')} FROM hop",
        "cable_path": "SELECT plant_id, turbine_id, path_km FROM cpath",
        "out_hourly": f"""SELECT plant_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour,
            {r('kwh', 2, 'energy_kwh')} FROM menergy""",
        "out_monthly": f"SELECT plant_id, {ym}, {r('monthly', 2, 'energy_kwh_month')} FROM monthly",
        "out_daily": f"SELECT plant_id, {ym}, {r('daily', 2, 'energy_kwh_day')} FROM daily",
        "out_firm": f"SELECT plant_id, {ym}, round_even(firm, 0)::BIGINT AS firm_kwh_day FROM firm_s",
        "out_surplus": f"""SELECT plant_id, {ym}, coalesce(surplus::DECIMAL(18, 2)::VARCHAR, 'N/A')
            AS surplus_kwh_day FROM surplus""",
        "month_list": """SELECT plant_id, year(m) AS year, month(m) AS month, 0e0 AS value FROM
            (SELECT plant_id, unnest(range(make_date(year(month) - 1, 12, 1), make_date(year(month), 12, 1),
            INTERVAL 1 MONTH)) AS m FROM firm_s)""",
        "union_series": f"""SELECT tower_id AS source, {stamp()}, {r('wind', 8, 'wind')} FROM tower
            JOIN weather USING (series_id) UNION ALL SELECT -1 - plant_id, strftime(ts, '%Y-%m-%d %H:%M:%S'),
            {r('wind', 8)} FROM farm JOIN weather USING (series_id)""",
        "correct_curves": f"SELECT model_id, rho_mean, idx, v_design, {r('vp', 8, 'vp')}, {r('vcth', 8, 'vcth')} FROM ccurve",
        "downwind_distance": f"SELECT {key}, lead_id, {r('x_dist', 4, 'x_dist')} FROM behind",
        "ibl_height": f"SELECT {key}, {r('ibl', 4, 'ibl')} FROM ibl",
        "large_farm_correction": f"SELECT {key}, {r('corrected', 8, 'corrected')} FROM corr",
        "wake_speeds": f"SELECT {key}, {r('wake_speed', 8, 'wake_speed')} FROM wake",
        "cable_loss": f"""SELECT turbine_id, {r('''(p_nom * 1000 - pow(p_nom * 1000 / (kv * 1000), 2)
            * (mean_ohm * path_km)) / 1000''', 4, 'power')} FROM stat""",
        "connection_loss_wind": f"SELECT turbine_id, {r('p_nom * (1 - kpc / 100 - kt / 100 - kin / 100)', 4, 'power')} FROM stat",
        "turbine_power": f"SELECT {key}, {r('power', 4, 'power')} FROM power",
        "wind_plant": _plant_result(
            "windh", "farm", 24, "CASE WHEN measured THEN least(lowest, cap) ELSE least(lowest, cap) * 0.6e0 END"
        ),
        "wind_request_result": _plant_result(
            "windh", "farm", 24, "CASE WHEN measured THEN least(lowest, cap) ELSE least(lowest, cap) * 0.6e0 END"
        ),
        "wind_plant_status": """, spot AS (
            SELECT turbine_id, plant_id, plant_id % 6 AS fault, turbine_id % 20 AS k FROM turb
        ), faulty AS (
            SELECT plant_id, unnest(CASE fault
                WHEN 1 THEN CASE k WHEN 2 THEN ['coordinates'] WHEN 3 THEN ['distance'] WHEN 4 THEN
                    ['models'] ELSE [] END
                WHEN 2 THEN CASE WHEN k = 3 THEN ['cables'] WHEN k = 4 AND plant_id % 2 = 0 THEN ['towers'] ELSE [] END
                WHEN 3 THEN CASE WHEN turbine_id = (SELECT min(t.turbine_id) FROM turb t WHERE t.plant_id = spot.plant_id)
                    THEN ['strings', 'plant'] ELSE [] END
                ELSE [] END) AS task FROM spot
        ), driven AS (
            SELECT plant_id, tower.series_id FROM tower JOIN farm f USING (plant_id) WHERE f.measured
            UNION ALL SELECT plant_id, series_id FROM farm WHERE NOT measured
        ), holes AS (
            SELECT plant_id, CASE hour(ts) WHEN 5 THEN 'pressure' ELSE 'values' END AS task, count(DISTINCT row) AS n_bad
            FROM (SELECT *, row_number() OVER () AS row FROM driven WHERE series_id = 2) JOIN weather USING (series_id)
            WHERE hour(ts) IN (5, 7) GROUP BY ALL
        ), tables AS (
            SELECT plant_id, task, count(*) AS n_bad FROM faulty GROUP BY ALL UNION ALL SELECT * FROM holes
        ), later AS (
            SELECT plant_id, 'curves' AS task, count(*) AS n_bad FROM spot WHERE fault = 4 AND k = 6 GROUP BY ALL
            UNION ALL SELECT s.plant_id, 'thrust', count(*) FROM th JOIN spot s USING (turbine_id)
            WHERE fault = 5 AND k = 0 GROUP BY ALL
        ) SELECT * FROM tables UNION ALL SELECT * FROM later WHERE plant_id NOT IN (SELECT plant_id FROM tables)""",
        "solar_plant_status": """, hit AS (
            SELECT s_suppkey // 4 AS plant_id, s_suppkey % 4 AS k, (s_suppkey // 4) % 8 AS fault FROM supplier
        ) SELECT plant_id, unnest(CASE WHEN fault = 2 AND k = 1 THEN ['modules'] WHEN fault = 3 AND k = 2 THEN ['circuits']
            WHEN fault = 4 AND k = 3 THEN ['arrays'] WHEN fault = 5 AND k = 0 THEN ['inverter_points', 'inverter_fit']
            ELSE [] END) AS task, 1 AS n_bad FROM hit
        UNION ALL SELECT DISTINCT plant_id, CASE fault WHEN 1 THEN 'coordinates' WHEN 6 THEN 'stamps' ELSE 'values' END, 1
            FROM hit WHERE fault IN (1, 6) OR (fault = 7 AND EXISTS (SELECT 1 FROM events WHERE hour(ts) = 12))""",
        "solar_request_result": _plant_result(
            "solh", "site", 12, "CASE WHEN measured THEN least(lowest, cap) ELSE lowest * 0.8e0 END"
        ),
        "sun_position": f"SELECT {skey}, {r('zenith', 4, 'zenith')}, {r('azimuth', 4, 'azimuth')} FROM sun",
        "extraterrestrial": f"SELECT event_id, {r('1366.1e0 * orb', 4, 'iext')} FROM"
            " (SELECT event_id, 1.00011e0 + 0.034221e0 * cos(b) + 0.00128e0 * sin(b)"
            " + 0.000719e0 * cos(2 * b) + 0.000077e0 * sin(2 * b) AS orb FROM"
            " (SELECT event_id, 2 * pi() * (dayofyear(ts) - 1) / 365 AS b FROM events))",
        "dni_disc": f"""SELECT {skey}, {r('dni0', 6, 'dni')}, {r('kt', 6, 'kt')}, {r('airmass', 6, 'airmass')} FROM disc""",
        "dhi_closure": f"SELECT {skey}, {r('dni', 6, 'dni')}, {r('dhi', 6, 'dhi')} FROM irr",
        "surface_orientation": f"SELECT {akey}, {r('tilt', 4, 'tilt')}, {r('cos(radians(saz))', 6, 'facing_north')} FROM ori",
        "poa_perez": f"""SELECT {akey}, {r('beam', 3, 'beam')}, {r('sky', 3, 'sky')}, {r('ground', 3, 'ground')} FROM per3""",
        "poa_bifacial": f"SELECT {akey}, {r('poa', 3, 'poa')} FROM (SELECT * REPLACE (coalesce(poa, 0) AS poa) FROM poa)",
        "panel_temperature": f"SELECT {akey}, {r('temp', 4, 'temp')} FROM ptemp",
        "circuit_params": f"""SELECT {akey}, {r('il', 6, 'il')}, {r('i0 * 1e12', 4, 'i0_e12')}, {r('a', 6, 'a')} FROM circ""",
        "max_power_point": f"""SELECT {akey}, {r('i_sc', 4, 'i_sc')}, {r('v_oc', 4, 'v_oc')}, {r('i_mp', 4, 'i_mp')},
            {r('v_mp', 4, 'v_mp')}, {r('p_mp', 4, 'p_mp')}, {r('i_x', 4, 'i_x')}, {r('i_xx', 4, 'i_xx')} FROM mpp""",
        "string_scaling": f"SELECT {akey}, {r('v_mp', 3, 'v_mp')}, {r('i_mp', 3, 'i_mp')}, {r('p_mp', 2, 'p_mp')} FROM strs",
        "dc_losses": f"SELECT {akey}, {r('v_mp', 3, 'v_mp')}, {r('i_mp', 3, 'i_mp')}, {r('p_mp', 2, 'p_mp')} FROM dclost",
        "inverter_ac": f"SELECT inverter_id, {stamp()}, {r('p_ac', 2, 'p_ac')} FROM ac",
        "plant_losses_solar": f"SELECT {skey}, {r('kwh', 4, 'kwh')} FROM solh",
        "solar_plant": _plant_result(
            "solh", "site", 12, "CASE WHEN measured THEN least(lowest, cap) ELSE lowest * 0.8e0 END"
        ),
    }


def _needed(text: str) -> list[str]:
    """Building blocks that a SELECT refers to, in the order of their definition."""
    seen: set[str] = set()

    def visit(part: str) -> None:
        for name in set(re.findall(r"[a-z_0-9]+", part)) & set(CTES) - seen:
            seen.add(name)
            visit(CTES[name])

    visit(text)
    order = list(CTES)
    return sorted(seen, key=order.index)


def oracle_sql() -> dict[str, str]:
    result = {}
    for name, select in _finals().items():
        blocks = []
        for block in _needed(select):
            body = CTES[block].replace("{segments}", segment_rows()) if block == "seg" else CTES[block]
            blocks.append(f"{block} AS ({body})")
        head, tail = ", ".join(blocks), select.strip()
        if tail.startswith(","):
            result[name] = f"WITH {head} {tail}" if head else f"WITH {tail[1:]}"
        else:
            result[name] = f"WITH {head} {tail}" if head else tail
    return result

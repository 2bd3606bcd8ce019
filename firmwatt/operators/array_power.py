"""Module temperature, equivalent circuit and maximum power per array and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.constants import BAND_GAP_EV, BAND_GAP_SLOPE, BOLTZMANN_EV
from firmwatt.functions.text import technology_code

# Solver steps. Each start lies close to its root, on the side from which the steps
# are monotone.
STEPS = 5
CURVE_STEPS = 6


def normalize_technology(modules: DataFrame) -> DataFrame:
    return modules.withColumn("tech_code", technology_code(F.col("technology")))


def panel_temperature(df: DataFrame) -> DataFrame:
    """Cell temperature ``temp`` from air temperature and irradiance."""
    rise = (F.col("t_noct") - 20) / 800 * F.col("poa")
    return df.withColumn("temp", F.col("ta") + rise)


def circuit_params(df: DataFrame, gap_slope: float = BAND_GAP_SLOPE) -> DataFrame:
    """Single-diode parameters at the row's irradiance and temperature.

    De Soto 2006 with the temperature adjustment of Dobos 2012. Adds ``il, i0, rs,
    rsh, a``; ``rsh`` is NULL without light.
    """
    col = F.col
    kelvin = col("temp") + 273.15
    ratio = kelvin / 298.15
    warm = col("temp") - 25
    gap = F.lit(BAND_GAP_EV) * (F.lit(1.0) + F.lit(gap_slope) * warm)
    exponent = F.lit(BAND_GAP_EV / (BOLTZMANN_EV * 298.15)) - gap / (kelvin * BOLTZMANN_EV)
    alpha = col("alpha_sc") * (F.lit(1.0) - col("adjust") / 100)
    return df.withColumns(
        {
            "il": col("poa") / 1000 * (col("il_ref") + alpha * warm),
            "i0": col("i0_ref") * F.pow(ratio, 3) * F.exp(exponent),
            "rs": col("rs_ref"),
            "rsh": F.when(col("poa") > 0, col("rsh_ref") * 1000 / col("poa")),
            "a": col("a_ref") * ratio,
        }
    )


def _diode(df: DataFrame, *roots: str) -> DataFrame:
    """Current and its slope at the diode voltage in each named column."""
    col = F.col
    df = df.withColumns({f"_e{u}": col("i0") * F.exp(col(u) / col("a")) for u in roots})
    found = {}
    for u in roots:
        found[f"_i{u}"] = col("il") + col("i0") - col(f"_e{u}") - col(u) / col("rsh")
        found[f"_d{u}"] = -col(f"_e{u}") / col("a") - F.lit(1.0) / col("rsh")
    return df.withColumns(found)


def _at_voltage(u: str, target: Column) -> Column:
    """One step towards the diode voltage at which the module shows ``target``."""
    col = F.col
    return col(u) - (col(u) - col("rs") * col(f"_i{u}") - target) / (
        F.lit(1.0) - col("rs") * col(f"_d{u}")
    )


def max_power_point(df: DataFrame) -> DataFrame:
    """Characteristic points of the single-diode curve per row.

    With the diode voltage ``u``, current ``I(u) = il - i0 (e^(u/a) - 1) - u/rsh``
    and voltage ``V(u) = u - I rs`` are explicit, so every point is a root in ``u``.
    A fixed number of Newton steps, chained as projections, finds it inside the row:
    no operating point is expanded into a sweep. Rows without light give zeros.

    Store the result before filtering on it: a filter would be pushed below the
    projections and drag all steps along.
    """
    col = F.col
    kept = df.columns
    il, i0, rs, rsh, a = (col(c) for c in ("il", "i0", "rs", "rsh", "a"))
    lit = (il > 0) & rsh.isNotNull()
    # Neither the diode nor the shunt alone lets the open voltage exceed its bound.
    df = df.withColumn("_top", F.when(lit, F.least(a * F.log(il / i0 + 1), il * rsh)))

    # At the peak e^(u/a) i0 (1 + (u - 2 I rs) / a) is about il; u and I are bounded
    # here so that the start is not below the root.
    reach = F.greatest(col("_top") - a * 4 - il * rs * 2, F.lit(0.0))
    df = df.withColumns(
        {
            "_peak": col("_top") - a * F.log(reach / a + 1),
            "_open": col("_top"),
            "_short": F.when(lit, il * rs),
        }
    )
    for _ in range(STEPS):
        df = _diode(df, "_peak", "_open", "_short")
        i, d, c = col("_i_peak"), col("_d_peak"), -col("_e_peak") / (a * a)
        v, dv = col("_peak") - i * rs, F.lit(1.0) - d * rs
        df = df.withColumns(
            {
                "_peak": col("_peak") - (d * v + i * dv) / (c * v + d * dv * 2 - i * c * rs),
                "_open": col("_open") - col("_i_open") / col("_d_open"),
                "_short": _at_voltage("_short", F.lit(0.0)),
            }
        )
    df = _diode(df, "_peak", "_short")
    df = df.withColumn("_v", col("_peak") - col("_i_peak") * rs)

    df = df.withColumns({"_t_x": col("_open") / 2, "_t_xx": (col("_open") + col("_v")) / 2})
    df = df.withColumns(
        {
            "_x": F.least(col("_t_x") + il * rs, col("_open")),
            "_xx": F.least(col("_t_xx") + il * rs, col("_open")),
        }
    )
    for _ in range(CURVE_STEPS):
        df = _diode(df, "_x", "_xx")
        df = df.withColumns(
            {"_x": _at_voltage("_x", col("_t_x")), "_xx": _at_voltage("_xx", col("_t_xx"))}
        )
    df = _diode(df, "_x", "_xx")
    found = {
        "i_sc": col("_i_short"),
        "v_oc": col("_open"),
        "i_mp": col("_i_peak"),
        "v_mp": col("_v"),
        "p_mp": col("_i_peak") * col("_v"),
        "i_x": col("_i_x"),
        "i_xx": col("_i_xx"),
    }
    values = [F.coalesce(v, F.lit(0.0)).alias(k) for k, v in found.items()]
    return df.select(*kept, *values)


def string_scaling(df: DataFrame) -> DataFrame:
    """Module values to array values by modules per string and strings."""
    series, parallel = F.col("modules_per_string"), F.col("strings")
    scaled = {c: F.col(c) * parallel for c in ("i_sc", "i_mp", "i_x", "i_xx")}
    scaled |= {c: F.col(c) * series for c in ("v_oc", "v_mp")}
    return df.withColumns(scaled | {"p_mp": F.col("p_mp") * series * parallel})


def dc_losses(df: DataFrame) -> DataFrame:
    """Soiling (``psi``) and shading (``l_pct``) losses on current and power."""
    keep = (F.lit(1.0) - F.col("psi") / 100) * (F.lit(1.0) - F.col("l_pct") / 100)
    return df.withColumns({c: F.col(c) * keep for c in ("i_mp", "p_mp")})

"""Manufacturer curves: density correction, cubic segments, lookup.

``points`` tables hold ``(model_id, idx, v, p, ct)``; a curve is one model at one
mean density, so there are as many curves as distinct pairs of the two, never one
per turbine. A curve is one row: its knots, the coefficients of its cubics and, for
every 1 m/s bin of speeds, the first cubic that can hold. It travels with the turbine's
row, so a speed finds its cubic by its bin and no row is ever joined by its curve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.functions.air import moist_density

# Lookup bins are 1 m/s wide; the two outermost ones are open-ended.
FIRST_BIN, LAST_BIN = -1, 60
#: A spline without knots at the second and the last but one point needs four points.
LEAST_POINTS = 4
#: Up to so many knots in one bin a cubic is found by comparisons in generated code.
MOST_STEPS = 64


def with_density(series: DataFrame) -> DataFrame:
    """Air density at hub height as column ``rho``."""
    return series.withColumn("rho", moist_density(F.col("ta"), F.col("pressure")))


def mean_density(series: DataFrame) -> DataFrame:
    """Mean density per series, rounded to two decimals."""
    return series.groupBy("series_id").agg(F.bround(F.avg("rho"), 2).alias("rho_mean"))


def design_speed(points: DataFrame) -> DataFrame:
    """Speed of the best power-to-cube ratio per model; 0 if none is positive."""
    ratio = F.try_divide(F.col("p"), F.pow(F.col("v"), 3))
    best = F.max_by("v", F.struct(F.col("ratio"), -F.col("idx")))
    return (
        points.withColumn("ratio", F.when(ratio > 0, ratio))
        .groupBy("model_id")
        .agg(
            F.coalesce(
                F.when(F.max("ratio").isNotNull(), best), F.lit(0.0)
            ).alias("v_design")
        )
    )


def correct_curves(points: DataFrame, models: DataFrame, densities: DataFrame) -> DataFrame:
    """Curve speeds moved to each mean density: ``vp`` for power, ``vcth`` for thrust.

    ``densities`` lists the ``(model_id, rho_mean)`` pairs in use. Where the mean
    equals the nominal density both speeds are the maker's.
    """
    v, vd, vn = F.col("v"), F.col("v_design"), F.col("v_nom")
    share = F.try_divide(v - vd, vn - vd)
    below = (v >= 0) & (v < vd)
    between = (v > vd) & (v <= vn)
    m = F.when(below, 1 / 3).when(between, F.lit(1 / 3) + share / 3).otherwise(2 / 3)
    n = F.when(below, 1 / 8).when(between, F.lit(1 / 8) + F.lit(1 / 3 - 1 / 8) * share).otherwise(1 / 3)
    ratio = F.col("rho_nom") / F.col("rho_mean")
    same = F.col("rho_nom") == F.col("rho_mean")

    def moved(exponent: Column) -> Column:
        return F.when(same, v).otherwise(F.least(v * F.pow(ratio, exponent), F.col("v_max")))

    nameplate = models.select("model_id", "rho_nom", "v_nom", "v_max")
    return (
        densities.join(nameplate, "model_id")
        .join(design_speed(points), "model_id")
        .join(points, "model_id")
        .select(
            "model_id", "rho_mean", "idx", "v", "p", "ct", "v_design",
            moved(m).alias("vp"), moved(n).alias("vcth"),
        )
    )


def _at(array: Column, place: Column | int) -> Column:
    return F.get(array, place if isinstance(place, Column) else F.lit(place))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda row: row[name]


def _second_coefficients(x: Column, slopes: dict[str, Column], h: Column, n: Column) -> dict[str, Column]:
    """The quadratic coefficient at every knot, per quantity.

    Smooth second derivatives give one equation per inner knot. Third derivatives that agree
    across the second and the last but one knot express the two outer unknowns by
    their neighbours, which leaves a tridiagonal system. It is solved by elimination, a fold over
    the equations, and by substitution, a fold over them backwards.
    """
    first, last = F.lit(1), n - 2

    def equation(i: Column) -> Column:
        left, right = _at(h, i - 1), _at(h, i)
        at_first, at_last = i == first, i == last
        under = F.when(at_first, 0.0).when(at_last, left - right * right / left).otherwise(left)
        over = F.when(at_last, 0.0).when(at_first, right - left * left / right).otherwise(right)
        middle = (left + right) * 2
        middle = middle + F.when(at_first, left * (left + right) / right).otherwise(0.0)
        middle = middle + F.when(at_last, right * (left + right) / left).otherwise(0.0)
        sides = [((_at(s, i) - _at(s, i - 1)) * 3).alias(q) for q, s in slopes.items()]
        return F.struct(under.alias("under"), middle.alias("middle"), over.alias("over"), *sides)

    nothing = F.struct(F.lit(0.0).alias("over"), *[F.lit(0.0).alias(q) for q in slopes])

    def eliminate(done: Column, row: Column) -> Column:
        above = F.element_at(done, -1)
        pivot = row["middle"] - row["under"] * above["over"]
        sides = [((row[q] - row["under"] * above[q]) / pivot).alias(q) for q in slopes]
        return F.concat(done, F.array(F.struct((row["over"] / pivot).alias("over"), *sides)))

    def substitute(done: Column, row: Column) -> Column:
        below = F.element_at(done, -1)
        found = [(row[q] - row["over"] * below[q]).alias(q) for q in slopes]
        return F.concat(done, F.array(F.struct(F.lit(0.0).alias("over"), *found)))

    rows = F.transform(F.sequence(first, last), equation)
    reduced = F.aggregate(rows, F.array(nothing), eliminate)
    solved = F.aggregate(F.reverse(F.slice(reduced, 2, n - 2)), F.array(nothing), substitute)
    inner = F.reverse(F.slice(solved, 2, n - 2))

    def with_ends(q: str) -> Column:
        c = F.transform(inner, _field(q))
        start = ((_at(h, 0) + _at(h, 1)) * _at(c, 0) - _at(h, 0) * _at(c, 1)) / _at(h, 1)
        a, b = _at(h, n - 2), _at(h, n - 3)
        end = ((a + b) * _at(c, n - 3) - a * _at(c, n - 4)) / b
        return F.concat(F.array(start), c, F.array(end))

    return {q: with_ends(q) for q in slopes}


def curve_segments(corrected: DataFrame) -> DataFrame:
    """One row per curve: ``model_id, rho_mean`` and the struct ``curve``.

    Both power and thrust are interpolated over the thrust-corrected speed. The
    end cubics extrapolate. Points that the top-speed limit made equal are dropped
    but for the first. A curve that then has fewer than four points or a missing
    value has no row. Its fields: ``knots``, the four coefficients of every cubic
    in ``p`` and ``ct``, and ``starts``, per bin the number of inner knots below it.
    """
    quantities = ("p", "ct")
    point = F.struct("vcth", "idx", *quantities)
    missing = F.lit(False)
    for name in ("vcth", *quantities):
        missing = missing | F.col(name).isNull() | F.isnan(name)
    rows = corrected.groupBy("model_id", "rho_mean").agg(
        F.array_sort(F.collect_list(point)).alias("_all"), F.max(missing).alias("_missing")
    )
    kept = F.filter("_all", lambda e, i: (i == 0) | (e["vcth"] != _at(F.col("_all"), i - 1)["vcth"]))
    rows = rows.withColumn("_kept", kept).filter(~F.col("_missing") & (F.size("_kept") >= LEAST_POINTS))
    rows = rows.withColumns(
        {"x": F.transform("_kept", _field("vcth")), "n": F.size("_kept")}
        | {q: F.transform("_kept", _field(q)) for q in quantities}
    )
    pieces = F.sequence(F.lit(0), F.col("n") - 2)
    rows = rows.withColumn("h", F.transform(pieces, lambda i: _at(F.col("x"), i + 1) - _at(F.col("x"), i)))

    def rise(q: str) -> Column:
        return F.transform(pieces, lambda i: (_at(F.col(q), i + 1) - _at(F.col(q), i)) / _at(F.col("h"), i))

    rows = rows.withColumns({f"s_{q}": rise(q) for q in quantities})
    bends = _second_coefficients(F.col("x"), {q: F.col(f"s_{q}") for q in quantities}, F.col("h"), F.col("n"))
    rows = rows.withColumns({f"b_{q}": bend for q, bend in bends.items()})

    def cubics(q: str) -> Column:
        def one(i: Column) -> Column:
            h, here, after = _at(F.col("h"), i), _at(F.col(f"b_{q}"), i), _at(F.col(f"b_{q}"), i + 1)
            slope = _at(F.col(f"s_{q}"), i) - h * (here * 2 + after) / 3
            return F.array(_at(F.col(q), i), slope, here, (after - here) / (h * 3))

        return F.flatten(F.transform(pieces, one)).alias(q)

    inner = F.slice("x", F.lit(2), F.col("n") - 2)
    bins = F.sequence(F.lit(FIRST_BIN), F.lit(LAST_BIN))
    starts = F.transform(
        bins, lambda b: F.when(b == FIRST_BIN, 0).otherwise(F.size(F.filter(inner, lambda k: k <= b)))
    )
    curve = F.struct(F.col("x").alias("knots"), *[cubics(q) for q in quantities], starts.alias("starts"))
    return rows.select("model_id", "rho_mean", curve.alias("curve"))


def speed_bin(v: Column) -> Column:
    """Lookup bin of a speed."""
    clamped = F.least(F.greatest(v, F.lit(float(FIRST_BIN))), F.lit(float(LAST_BIN)))
    return F.floor(clamped).cast("int")


def lookup_steps(segments: DataFrame) -> int:
    """The most inner knots that any curve has in one bin. ``segments`` should be stored."""
    starts, inner = F.col("curve.starts"), F.size("curve.knots") - 2
    ends = F.concat(F.slice(starts, 2, LAST_BIN - FIRST_BIN), F.array(inner))
    most = segments.agg(F.max(F.array_max(F.zip_with(ends, starts, lambda e, s: e - s)))).first()[0]
    return most or 0


def with_curves(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows with ``curve``, the curve of their ``model_id`` and ``rho_mean``; NULL without one."""
    return df.join(segments, ["model_id", "rho_mean"], "left")


def curve_value(df: DataFrame, quantity: str, speed: str, out: str, steps: int) -> DataFrame:
    """Value of the row's ``curve`` at its speed; NULL without a curve or for no number.

    The bin of the speed gives the first cubic that can hold; each of the next ``steps``
    knots at or below the speed moves it on by one.
    """
    x, start = F.nanvl(F.col(speed), F.lit(None).cast("double")), F.col("_start")
    knots, cubics = F.col("curve.knots"), F.col(f"curve.{quantity}")
    passed = start
    if steps <= MOST_STEPS:
        for k in range(steps):
            # the last knot ends the last cubic, which extrapolates
            beyond = (start + k < F.size(knots) - 2) & (_at(knots, start + k + 1) <= F.col("_x"))
            passed = passed + F.coalesce(beyond.cast("int"), F.lit(0))
    else:
        inner = F.slice(knots, F.lit(2), F.size(knots) - 2)
        passed = F.size(F.filter(inner, lambda k: k <= F.col("_x")))
    dx = F.col("_x") - _at(knots, F.col("_cubic"))
    c0, c1, c2, c3 = (_at(cubics, F.col("_cubic") * 4 + k) for k in range(4))
    return (
        df.withColumn("_x", x)
        .withColumn("_start", _at(F.col("curve.starts"), speed_bin(F.col("_x")) - FIRST_BIN))
        .withColumn("_cubic", passed)
        .withColumn(out, c0 + dx * (c1 + dx * (c2 + dx * c3)))
        .drop("_x", "_start", "_cubic")
    )


def curve_lookup(
    df: DataFrame, segments: DataFrame, quantity: str, speed: str, out: str
) -> DataFrame:
    """Value of a curve at the speed in each row (keys ``model_id, rho_mean``).

    For rows that do not hold their turbine's curve; a plan gives the curve to its turbines
    (``with_curves``) and reads it from their hours (``curve_value``).
    """
    return curve_value(with_curves(df, segments), quantity, speed, out, lookup_steps(segments)).drop("curve")

"""Series cleaning: text to values, time stamps, filters, index repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.functions.text import decimal_comma, local_stamp


def parse_numbers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Decimal-comma text columns to doubles, as ``{text column: new name}``."""
    return df.select(
        *[c for c in df.columns if c not in columns],
        *[decimal_comma(F.col(old)).alias(new) for old, new in columns.items()],
    )


def add_stamp(df: DataFrame) -> DataFrame:
    """``Ano, Mes, Dia, Hora`` to one civil time column ``ts``."""
    stamp = local_stamp(*[F.col(c) for c in ("Ano", "Mes", "Dia", "Hora")])
    return df.withColumn("ts", stamp).drop("Ano", "Mes", "Dia", "Hora")


def add_utc(df: DataFrame, zone: str = "tz") -> DataFrame:
    """UTC companion of the civil time, by the zone column of each row."""
    utc = F.convert_timezone(F.col(zone), F.lit("UTC"), F.col("ts"))
    return df.withColumn("ts_utc", utc)


def clean_wind(raw: DataFrame) -> DataFrame:
    """Raw wind series to ``ts, direction, pressure, ta, wind`` plus its keys."""
    names = {
        "DireccionViento": "direction",
        "PresionAtmosferica": "pressure",
        "Ta": "ta",
        "VelocidadViento": "wind",
    }
    return parse_numbers(add_stamp(raw), names)


def clean_solar(raw: DataFrame) -> DataFrame:
    """Raw solar series to ``ts, ghi`` (Wh/m2) and ``ta`` plus its keys."""
    return scale_ghi(parse_numbers(add_stamp(raw), {"Ghi": "ghi_kwh", "Ta": "ta"}))


def scale_ghi(df: DataFrame) -> DataFrame:
    return df.withColumn("ghi", F.col("ghi_kwh") * 1000).drop("ghi_kwh")


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)


def is_daylight() -> Column:
    """From 06:00:00 to 18:00:00 local time, both ends included."""
    return seconds_of_day(F.col("ts")).between(6 * 3600, 18 * 3600)


def daylight(df: DataFrame) -> DataFrame:
    return df.filter(is_daylight())


def is_lit() -> Column:
    """Any beam or diffuse irradiance."""
    return (F.col("dni") != 0) | (F.col("dhi") != 0)


def drop_dark(df: DataFrame) -> DataFrame:
    return df.filter(is_lit())


def clamp_low_sun(df: DataFrame) -> DataFrame:
    """No irradiance below 3 degrees of sun; impossible pairs become zero."""
    low = F.col("zenith") > 87
    dni = F.when(low, F.lit(0.0)).otherwise(F.col("dni"))
    dhi = F.when(low, F.lit(0.0)).otherwise(F.col("dhi"))
    impossible = (dni <= 0) & (dhi < 0)
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "dni": F.when(impossible, zero).otherwise(dni),
            "dhi": F.when(impossible, zero).otherwise(dhi),
        }
    )


def align(keys: list[str], *frames: DataFrame) -> DataFrame:
    """Index alignment of several series: inner equi-joins on the same keys."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.join(frame, keys)
    return result


def restore_index(
    spine: DataFrame, computed: DataFrame, keys: list[str], values: list[str]
) -> DataFrame:
    """Every row of the spine, with computed values or 0 where there are none."""
    filled = [F.coalesce(F.nanvl(F.col(v), F.lit(0.0)), F.lit(0.0)).alias(v) for v in values]
    return spine.join(computed.select(*keys, *values), keys, "left").select(
        *spine.columns, *filled
    )

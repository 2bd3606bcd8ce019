"""Text to values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmwatt.constants import TECHNOLOGY_CODES


def decimal_comma(text: Column) -> Column:
    """``'12,5'`` to ``12.5``; text that is no number gives NULL."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def technology_code(spelling: Column) -> Column:
    """Code of a module technology; unknown spellings give NULL."""
    by_code: dict[str, list[str]] = {}
    for text, code in TECHNOLOGY_CODES.items():
        by_code.setdefault(code, []).append(text)
    result = F.lit(None).cast("string")
    for code, texts in by_code.items():
        result = F.when(spelling.isin(texts), F.lit(code)).otherwise(result)
    return result


def local_stamp(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Civil time without zone, from its integer parts; parts that are no date give NULL."""
    zero = F.lit(0)
    parts = [part.cast("string").try_cast("int") for part in (year, month, day, hour)]
    return F.try_make_timestamp_ntz(*parts, zero, zero)

"""Numeric helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def capped(value: Column, limit: Column) -> Column:
    """``min(value, limit)`` that keeps a missing value missing.

    Spark's ``least`` skips NULL, which would turn a missing reading into the
    limit itself.
    """
    return F.when(value > limit, limit).otherwise(value)


def floored(value: Column, limit: float = 0.0) -> Column:
    """``max(value, limit)`` that keeps a missing value missing."""
    return F.when(value < limit, F.lit(limit)).otherwise(value)


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner form, lowest order first."""
    result = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        result = result * x + F.lit(c)
    return result


def refine(start: Column, step: Callable[[Column], Column], times: int) -> Column:
    """The result of a fixed number of solver steps from ``start``.

    The steps are folded inside one expression of constant size, so a filter on the
    result can be pushed below it without growing.
    """
    rounds = F.array_repeat(F.lit(0), times)
    return F.aggregate(rounds, start, lambda value, _: step(value))

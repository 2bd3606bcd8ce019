"""Wake geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_share(rotor: Column, wake: Column, distance: Column) -> Column:
    """Share of a rotor disc (radius ``rotor``) inside a wake disc (radius ``wake``).

    ``distance`` is between the two centres. Angles that are not defined count as
    no overlap.
    """
    safe = F.nullif(distance, F.lit(0.0))
    t2, e2 = rotor * rotor, wake * wake
    chord = F.abs((t2 - e2 + distance * distance) / (safe * 2))
    half = F.sqrt(F.abs(t2 - chord * chord))
    rotor_part = t2 * F.acos(chord / rotor)
    wake_part = e2 * F.acos((distance - chord) / wake)
    lens = rotor_part + wake_part - distance * half
    area = t2 * F.lit(math.pi)
    inside = F.sqrt(e2 - t2)
    cut = distance + rotor >= wake
    covered = (
        F.when(distance >= rotor + wake, F.lit(0.0))
        .when(distance >= wake, lens)
        .when(cut & (distance > inside), lens)
        .when(cut & (distance <= inside), area - rotor_part + wake_part - distance * half)
        .otherwise(area)
    )
    return F.coalesce(F.nanvl(covered, F.lit(0.0)) / area, F.lit(0.0))


def speed_loss(speed: Column, thrust: Column, rotor: Column, wake: Column) -> Column:
    """How much slower the air in a wake is than at its source."""
    ratio = rotor / wake
    return speed * (F.lit(1.0) - F.sqrt(F.lit(1.0) - thrust)) * ratio * ratio

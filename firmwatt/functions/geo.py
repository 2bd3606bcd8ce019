"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmwatt.constants import EARTH_RADIUS_KM


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in km; all angles in degrees."""
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_dlat * half_dlat + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def distance_km(
    lat1: Column, lon1: Column, elev1: Column, lat2: Column, lon2: Column, elev2: Column
) -> Column:
    """Great-circle distance combined with the height difference (metres)."""
    flat = great_circle_km(lat1, lon1, lat2, lon2)
    climb = (elev2 - elev1) / 1000
    return F.sqrt(flat * flat + climb * climb)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def east_m(lat0: Column, lon0: Column, lon: Column) -> Column:
    """Signed metres east of an origin, along the origin's parallel."""
    return F.signum(lon - lon0) * great_circle_km(lat0, lon0, lat0, lon) * 1000


def north_m(lat0: Column, lon0: Column, lat: Column) -> Column:
    """Signed metres north of an origin, along the origin's meridian."""
    return F.signum(lat - lat0) * great_circle_km(lat0, lon0, lat, lon0) * 1000


def wind_angle(direction_deg: Column) -> Column:
    """Compass direction as a mathematical angle in radians."""
    return F.radians(F.lit(90.0) - direction_deg)

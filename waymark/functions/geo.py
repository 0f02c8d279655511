"""Distances on the sphere, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.settings import EARTH_RADIUS_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres. NULL in, NULL out."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Rounding may lift `a` above 1, where the arc sine is NaN: half the globe. least(1, a) would not do, it
    # skips NULL and would turn a missing point into that distance.
    return F.lit(2.0 * EARTH_RADIUS_M) * F.nanvl(F.asin(F.sqrt(a)), F.lit(math.pi / 2.0))

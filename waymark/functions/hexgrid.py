"""Hexagonal grid over an equal-area projection.

Cells have the mean area of the usual resolution-8 cell and grow by 7 per coarser level.
A cell is the pair of axial coordinates (q, r); its text id is `resolution:q:r`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.settings import EARTH_RADIUS_M, HEX_RESOLUTION

# Fixed value: mean cell area at resolution 8, square metres
CELL_AREA_M2 = 737_327.598


def hex_size(resolution: int = HEX_RESOLUTION) -> float:
    """Centre-to-corner distance in projected metres."""
    area = CELL_AREA_M2 * 7.0 ** (8 - resolution)
    return math.sqrt(2.0 * area / (3.0 * math.sqrt(3.0)))


def cell_of(lat: Column, lon: Column, resolution: int = HEX_RESOLUTION) -> tuple[Column, Column]:
    """Axial (q, r) of the cell holding a point."""
    size = F.lit(hex_size(resolution))
    x = F.lit(EARTH_RADIUS_M) * F.radians(lon)
    y = F.lit(EARTH_RADIUS_M) * F.sin(F.radians(lat))
    q = (F.lit(math.sqrt(3.0) / 3.0) * x - y / F.lit(3.0)) / size
    r = (F.lit(2.0 / 3.0) * y) / size
    # round the three cube coordinates; the one furthest from its integer follows from the others
    q0 = F.floor(q + 0.5).cast("bigint")
    r0 = F.floor(r + 0.5).cast("bigint")
    p0 = F.floor(-q - r + 0.5).cast("bigint")
    dq, dr, dp = F.abs(q0 - q), F.abs(r0 - r), F.abs(p0 + q + r)
    q_off = (dq > dp) & (dq > dr)
    r_off = ~q_off & (dr > dp)
    return (
        F.when(q_off, -p0 - r0).otherwise(q0),
        F.when(r_off, -q0 - p0).otherwise(r0),
    )


def cell_center(q: Column, r: Column, resolution: int = HEX_RESOLUTION) -> tuple[Column, Column]:
    """(latitude, longitude) of a cell's centre."""
    size = hex_size(resolution)
    x = F.lit(size * math.sqrt(3.0)) * (q + r / F.lit(2.0))
    return row_latitude(r, resolution), F.degrees(x / F.lit(EARTH_RADIUS_M))


def row_latitude(r: Column, resolution: int = HEX_RESOLUTION) -> Column:
    """Latitude shared by the centres of all cells of one grid row."""
    sine = F.lit(1.5 * hex_size(resolution) / EARTH_RADIUS_M) * r
    sine = F.when(sine > 1.0, F.lit(1.0)).when(sine < -1.0, F.lit(-1.0)).otherwise(sine)
    return F.degrees(F.asin(sine))


def cell_id(q: Column, r: Column, resolution: int = HEX_RESOLUTION) -> Column:
    return F.concat_ws(":", F.lit(str(resolution)), q.cast("string"), r.cast("string"))

"""Polygons as Column expressions.

A shape is read from GeoJSON (Polygon or MultiPolygon) into `parts`: polygons of rings of [lon, lat].
Tests work on its flat list of `edges`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.schemas import RINGS
from waymark.settings import EARTH_RADIUS_M


def read_parts(geojson: Column) -> Column:
    """Polygons of a GeoJSON geometry; NULL when the text is no polygon."""
    kind = F.get_json_object(geojson, "$.type")
    coordinates = F.get_json_object(geojson, "$.coordinates")
    return F.when(kind == "Polygon", F.array(F.from_json(coordinates, RINGS))).when(
        kind == "MultiPolygon", F.from_json(coordinates, f"array<{RINGS}>")
    )


def ring_edges(ring: Column) -> Column:
    """Edges of one closed ring; none for an empty one."""
    count = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), count),
        F.slice(ring, F.lit(2), count),
        lambda a, b: F.struct(
            F.get(a, F.lit(0)).alias("x1"),
            F.get(a, F.lit(1)).alias("y1"),
            F.get(b, F.lit(0)).alias("x2"),
            F.get(b, F.lit(1)).alias("y2"),
        ),
    )


def part_edges(part: Column) -> Column:
    return F.flatten(F.transform(part, ring_edges))


def shape_edges(parts: Column) -> Column:
    return F.flatten(F.transform(parts, part_edges))


def with_shape(df: DataFrame, geojson: str = "geojson") -> DataFrame:
    """Add `edges` and the bounding box; rows without a readable shape drop out."""
    shaped = df.withColumn("edges", shape_edges(read_parts(F.col(geojson)))).where(F.size("edges") > 0)
    ends = {"min_lon": (F.array_min, "x1"), "max_lon": (F.array_max, "x1")}
    ends |= {"min_lat": (F.array_min, "y1"), "max_lat": (F.array_max, "y1")}
    return shaped.withColumns({name: pick(F.col(f"edges.{axis}")) for name, (pick, axis) in ends.items()})


def contains(edges: Column, lat: Column, lon: Column) -> Column:
    """True for points strictly inside: an odd number of edges to the east, and on no edge."""
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e.y1 > lat) != (e.y2 > lat)) & (lon < e.x1 + (lat - e.y1) * F.try_divide(e.x2 - e.x1, e.y2 - e.y1)),
            1,
        ).otherwise(0),
    )
    return (crossings % 2 == 1) & ~on_boundary(edges, lat, lon)


def on_boundary(edges: Column, lat: Column, lon: Column) -> Column:
    return F.exists(
        edges,
        lambda e: ((e.x2 - e.x1) * (lat - e.y1) == (e.y2 - e.y1) * (lon - e.x1))
        & lon.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
        & lat.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)),
    )


def boundary_distance_m(edges: Column, lat: Column, lon: Column) -> Column:
    """Metres from a point to the nearest edge, on the plane that touches the globe at the point."""
    per_lat = F.lit(EARTH_RADIUS_M) * F.radians(F.lit(1.0))
    per_lon = per_lat * F.cos(F.radians(lat))

    def to_edge(e: Column) -> Column:
        ax, ay = (e.x1 - lon) * per_lon, (e.y1 - lat) * per_lat
        dx, dy = (e.x2 - e.x1) * per_lon, (e.y2 - e.y1) * per_lat
        along = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
        along = F.when(along < 0.0, F.lit(0.0)).when(along > 1.0, F.lit(1.0)).otherwise(along)
        nx, ny = ax + along * dx, ay + along * dy
        return F.sqrt(nx * nx + ny * ny)

    return F.array_min(F.transform(edges, to_edge))

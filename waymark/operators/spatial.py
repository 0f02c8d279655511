"""Joins of points with polygons and zones.

Polygon joins are equi-joins on grid cells. A shape is listed under cells of two levels: on the level where its box covers
few cells, those that lie wholly inside it; where its outline passes, the cells of the next finer level. Cells outside are
left out, and points in inner cells need no look at the outline. A point is listed under its one cell of every level in
use. So a pair meets at most once, and Spark chooses by actual size whether to broadcast the shapes or shuffle (and split
busy cells). The grid is periodic: a shape that reaches past 180 degrees is listed on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions import hexgrid
from waymark.functions.geo import haversine_m
from waymark.functions.polygons import boundary_distance_m, contains, read_parts, ring_edges, with_shape
from waymark.session import tabled

# Side of a cell per level, degrees: each is cut into 4 x 4 of the level before. The coarsest covers the globe with a few.
LEVELS = tuple(0.02 * 4.0**i for i in range(7))
CELLS_PER_AXIS = 4
CELL = ["_level", "_row", "_col"]
#: The cell of rows without a place.
NO_CELL = -(2**62)
#: Levels of the cells that list zones; a cell is cut into 2**bits x 2**bits of the next level.
ZONE_LEVELS, ZONE_BITS = 9, 2
#: The coarsest of these levels on which a place is looked up: that of `ZONE_CELL_DEGREES`.
PLACED = 3


def _index(value: Column, side: float | Column) -> Column:
    return F.floor(value / side).cast("int")


def _side(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def around_the_globe(shapes: DataFrame) -> DataFrame:
    """Shapes with `_shift`, once for each turn of the globe with which their box meets longitudes from -180 to 180.

    The box is moved by the shift; a point at `lon` is at `lon - _shift` in the shape's own coordinates.
    """
    turned = shapes.withColumn("_shift", F.explode(F.array(*[F.lit(x) for x in (0.0, 360.0, -360.0)])))
    turned = turned.withColumns({name: F.col(name) + F.col("_shift") for name in ("min_lon", "max_lon")})
    return turned.where((F.col("max_lon") >= -180.0) & (F.col("min_lon") <= 180.0))


def nearest_turn(lon: Column) -> Column:
    """Of the turns of a shape, the one whose middle is nearest to the point: so a pair counts once."""
    off = lon - (F.col("min_lon") + F.col("max_lon")) / 2.0
    return (off > -180.0) & (off <= 180.0)


def shape_cells(shapes: DataFrame) -> DataFrame:
    """One row per shape and cell that its box covers, on the level where they are at most 5 x 5."""
    span = F.greatest(F.col("max_lat") - F.col("min_lat"), F.least(F.col("max_lon") - F.col("min_lon"), F.lit(360.0)))
    level = F.lit(len(LEVELS) - 1)
    for i in range(len(LEVELS) - 2, -1, -1):
        level = F.when(span <= LEVELS[i] * CELLS_PER_AXIS, F.lit(i)).otherwise(level)
    sized = shapes.withColumn("_level", level).withColumn("_side", _side(F.col("_level")))
    rows = F.sequence(_index(F.col("min_lat"), F.col("_side")), _index(F.col("max_lat"), F.col("_side")))
    west, east = F.greatest("min_lon", F.lit(-180.0)), F.least("max_lon", F.lit(180.0))
    columns = F.sequence(_index(west, F.col("_side")), _index(east, F.col("_side")))
    return sized.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(columns)).drop("_side")


def _cell_box(shift: Column) -> tuple[Column, Column, Column, Column]:
    """South, north, west and east of a cell in the coordinates of its shape, a little wider than it is."""
    side = _side(F.col("_level"))
    slack = 1e-9
    west, south = F.col("_col") * side - shift, F.col("_row") * side
    return south - slack, south + side + slack, west - slack, west + side + slack


def _crossed() -> Column:
    """Does an edge of the shape meet the cell? Their boxes overlap, and the cell's corners are not all on one side."""
    south, north, west, east = _cell_box(F.col("_shift"))

    def meets(e: Column) -> Column:
        overlap = (
            (F.least(e.x1, e.x2) <= east) & (F.greatest(e.x1, e.x2) >= west) & (F.least(e.y1, e.y2) <= north) & (F.greatest(e.y1, e.y2) >= south)
        )
        sides = [(e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1) for x in (west, east) for y in (south, north)]
        return overlap & (F.greatest(*sides) >= 0.0) & (F.least(*sides) <= 0.0)

    return F.exists("edges", meets)


def cover(shapes: DataFrame) -> DataFrame:
    """Cells of shapes (with `edges` and box, turned round the globe): `_inner` ones, and finer ones along the outline.

    Inner cells carry no edges, as their points need no test.
    """

    def marked(cells: DataFrame) -> DataFrame:
        south, north, west, east = _cell_box(F.col("_shift"))
        middle = contains(F.col("edges"), (south + north) / 2.0, (west + east) / 2.0)
        found = cells.withColumn("_crossed", _crossed()).withColumn("_inner", ~F.col("_crossed") & middle)
        return found.where("_crossed OR _inner")

    coarse = marked(shape_cells(shapes))
    quarters = F.sequence(F.lit(0), F.lit(3))
    finest = F.col("_level") == 0
    inner = coarse.where(F.col("_inner") | finest)
    along = coarse.where(~F.col("_inner") & ~finest).drop("_crossed", "_inner")
    fine = along.withColumn("_r", F.explode(quarters)).withColumn("_c", F.explode(quarters))
    fine = fine.withColumns(
        {"_level": F.col("_level") - 1, "_row": F.col("_row") * 4 + F.col("_r"), "_col": F.col("_col") * 4 + F.col("_c")}
    )
    cells = inner.unionByName(marked(fine.drop("_r", "_c"))).drop("_crossed")
    return cells.withColumn("edges", F.when(~F.col("_inner"), F.col("edges")))


def levels_in_use(cells: DataFrame) -> list[int]:
    """At most as many as there are levels."""
    return sorted(row["_level"] for row in cells.select("_level").distinct().collect())


def point_cells(points: DataFrame, lat: str, lon: str, levels: Iterable[int]) -> DataFrame:
    """Located points under their cell of each of these levels."""
    cells = [
        F.struct(
            F.lit(i).alias("_level"), _index(F.col(lat), LEVELS[i]).alias("_row"), _index(F.col(lon), LEVELS[i]).alias("_col")
        )
        for i in levels
    ]
    located = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if not cells:
        cells, located = [F.struct(*[F.lit(0).alias(name) for name in CELL])], located.limit(0)
    return located.select(*points.columns, F.inline(F.array(*cells)))


def points_in_fences(
    points: DataFrame, fences: DataFrame, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Every (point, fence) pair where the fence holds the point; points on the boundary are outside."""
    shapes = around_the_globe(with_shape(fences)).select(
        F.col("id").alias("geofence_id"), "edges", "min_lat", "max_lat", "min_lon", "max_lon", "_shift"
    )
    cells = tabled(cover(shapes))
    pairs = point_cells(points, lat, lon, levels_in_use(cells)).join(cells, CELL)
    inside = F.col("_inner") | contains(F.col("edges"), F.col(lat), F.col(lon) - F.col("_shift"))
    return pairs.where(nearest_turn(F.col(lon)) & inside).select(*points.columns, "geofence_id")


def check_fences(requests: DataFrame, fences: DataFrame) -> DataFrame:
    """Does the asked fence hold the asked point? An unknown fence does not."""
    shapes = with_shape(fences).select(F.col("id").alias("geofence_id"), "edges")
    inside = contains(F.col("edges"), F.col("latitude"), F.col("longitude"))
    return (
        requests.join(shapes, "geofence_id", "left")
        .withColumn("inside", F.coalesce(inside, F.lit(False)))
        .drop("edges")
    )


def zones_near_points(points: DataFrame, zones: DataFrame, radius_m: float = S.NEAR_ZONE_M) -> DataFrame:
    """Every (point, zone) pair at most `radius_m` apart, across the date line too; the distance is 0 inside a zone."""
    lat_margin = F.degrees(F.lit(radius_m / S.EARTH_RADIUS_M)) * 1.001
    widest = F.greatest(F.abs("min_lat"), F.abs("max_lat")) + lat_margin
    lon_margin = F.when(widest < 89.0, lat_margin / F.cos(F.radians(widest))).otherwise(F.lit(360.0))
    shapes = (
        with_shape(zones)
        .select(F.col("id").alias("zone_id"), "edges", "min_lat", "max_lat", "min_lon", "max_lon")
        .withColumns({"_lat": lat_margin, "_lon": lon_margin})
        .withColumns(
            {
                "min_lat": F.col("min_lat") - F.col("_lat"),
                "max_lat": F.col("max_lat") + F.col("_lat"),
                "min_lon": F.col("min_lon") - F.col("_lon"),
                "max_lon": F.col("max_lon") + F.col("_lon"),
            }
        )
        .drop("_lat", "_lon")
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    in_box = lat.between(F.col("min_lat"), F.col("max_lat")) & lon.between(F.col("min_lon"), F.col("max_lon"))
    there = lon - F.col("_shift")
    distance = F.when(contains(F.col("edges"), lat, there), F.lit(0.0)).otherwise(
        boundary_distance_m(F.col("edges"), lat, there)
    )
    cells = tabled(shape_cells(around_the_globe(shapes)))
    listed = point_cells(points, "latitude", "longitude", levels_in_use(cells))
    pairs = listed.join(cells, CELL).where(in_box & nearest_turn(lon))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= radius_m).select(
        *points.columns, "zone_id", "distance"
    )


def shape_edge_rows(shapes: DataFrame) -> DataFrame:
    """One row per edge: shape id, part, ring (0 is the outline, others are holes) and end points."""
    parts = shapes.select("id", F.posexplode(read_parts(F.col("geojson"))).alias("part", "rings"))
    rings = parts.select("id", "part", F.posexplode("rings").alias("ring", "points"))
    return rings.select("id", "part", "ring", F.inline(ring_edges(F.col("points"))))


def centroids(shapes: DataFrame) -> DataFrame:
    """Centre of each shape's area: outlines count as positive area, holes as negative, however they turn."""
    edges = shape_edge_rows(shapes)
    # relative to one corner of the shape, or the products of coordinates would cancel badly
    corner = edges.groupBy("id").agg(
        F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.avg("x1").alias("mid_x"), F.avg("y1").alias("mid_y")
    )
    ax, ay = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    bx, by = F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0")
    cross = ax * by - bx * ay
    ids = ["id", "x0", "y0", "mid_x", "mid_y"]
    rings = (
        edges.join(corner, "id")
        .select(*ids, "part", "ring", cross.alias("a"), ((ax + bx) * cross).alias("x"), ((ay + by) * cross).alias("y"))
        .groupBy(*ids, "part", "ring")
        .agg(F.sum("a").alias("a"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    )
    sign = F.signum("a") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    totals = rings.groupBy(*ids).agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("a", "x", "y")])
    # a shape without area falls back to the mean of its vertices
    return totals.select(
        "id",
        F.coalesce(F.col("y0") + F.try_divide("y", F.col("a") * 3.0), "mid_y").alias("lat"),
        F.coalesce(F.col("x0") + F.try_divide("x", F.col("a") * 3.0), "mid_x").alias("lon"),
    )


def hex_cells_of_shapes(zones: DataFrame, resolution: int = S.HEX_RESOLUTION) -> DataFrame:
    """Distinct hex cells (q, r) whose centre lies in a shape, and the cell of every shape's centroid.

    Filled row by row: all centres of a grid row share one latitude, so the edges that cross it give,
    sorted in pairs, the stretches inside. Work grows with edges and cells, not with their product.
    """
    size = hexgrid.hex_size(resolution)
    row_height = 1.5 * size / S.EARTH_RADIUS_M

    def row_of(lat: Column) -> Column:
        return F.sin(F.radians(lat)) / F.lit(row_height)

    edges = shape_edge_rows(zones)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(F.floor(row_of(low)).cast("bigint"), F.ceil(row_of(high)).cast("bigint"))
    crossing = (
        edges.withColumn("r", F.explode(rows))
        .withColumn("lat", hexgrid.row_latitude(F.col("r"), resolution))
        .where((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat")))
        .withColumn(
            "lon",
            F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")),
        )
    )
    stretches = (
        crossing.groupBy("id", "part", "r")
        .agg(F.array_sort(F.collect_list("lon")).alias("lons"))
        .select(
            "r",
            F.explode(F.sequence(F.lit(0), F.floor(F.size("lons") / 2).cast("int") - 1)).alias("i"),
            "lons",
        )
        .select("r", F.get("lons", F.col("i") * 2).alias("west"), F.get("lons", F.col("i") * 2 + 1).alias("east"))
    )

    def column_of(lon: Column) -> Column:
        metres = F.lit(S.EARTH_RADIUS_M) * F.radians(lon)
        return F.ceil(metres / F.lit(size * 3.0**0.5) - F.col("r") / F.lit(2.0)).cast("bigint")

    bounds = stretches.select("r", column_of(F.col("west")).alias("first"), column_of(F.col("east")).alias("end"))
    filled = bounds.where("first < end").select(
        F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("q"), "r"
    )
    q, r = hexgrid.cell_of(F.col("lat"), F.col("lon"), resolution)
    return filled.unionByName(centroids(zones).select(q.alias("q"), r.alias("r"))).distinct()


def _unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def zone_arrays(zones: DataFrame, per_row: int = S.ZONES_PER_ROW) -> DataFrame:
    """Places of zones per device in arrays of at most `per_row`: (device_id, zone_block, zones).

    Of zones in the very same place only the lowest id can be nearest, so a place is listed once.
    """
    known = zones.where(F.col("centroid_lat").isNotNull() & F.col("centroid_lng").isNotNull())
    lowest = known.groupBy("device_id", "centroid_lat", "centroid_lng").agg(F.min(F.struct("cluster_id", "label")).alias("_zone"))
    distinct = lowest.select("device_id", "_zone.*", "centroid_lat", "centroid_lng")
    ranked = Window.partitionBy("device_id").orderBy("cluster_id")
    x, y, z = _unit_vector(F.col("centroid_lat"), F.col("centroid_lng"))
    zone = F.struct("cluster_id", "label", "centroid_lat", "centroid_lng", x.alias("x"), y.alias("y"), z.alias("z"))
    return (
        distinct.withColumn("zone_block", F.floor((F.row_number().over(ranked) - 1) / F.lit(per_row)))
        .groupBy("device_id", "zone_block")
        .agg(F.array_sort(F.collect_list(zone)).alias("zones"))
    )


def with_nearest(df: DataFrame, alias: str) -> DataFrame:
    """Add the nearest of `zones` as a struct (distance, cluster_id, label); ties go to the lowest id.

    Zones are compared by squared chord, which orders like the distance and needs no trigonometry per zone;
    the great-circle distance is computed for the winner only.
    """
    x, y, z = _unit_vector(F.col("latitude"), F.col("longitude"))

    def chord(zone: Column) -> Column:
        dx, dy, dz = zone.x - F.col("_x"), zone.y - F.col("_y"), zone.z - F.col("_z")
        return dx * dx + dy * dy + dz * dz

    chords = df.withColumns({"_x": x, "_y": y, "_z": z}).withColumn("_chords", F.transform("zones", chord))
    # a point without a place has no nearest zone; it is given the first one, at no distance
    position = F.coalesce(F.array_position("_chords", F.array_min("_chords")), F.lit(1))
    winner = F.get("zones", position.cast("int") - 1)
    found = chords.withColumn("_winner", winner)
    near = F.struct(
        haversine_m(
            F.col("latitude"), F.col("longitude"), F.col("_winner.centroid_lat"), F.col("_winner.centroid_lng")
        ).alias("distance"),
        F.col("_winner.cluster_id").alias("cluster_id"),
        F.col("_winner.label").alias("label"),
    )
    known = F.col("_winner").isNotNull()
    return found.withColumn(alias, F.when(known, near)).drop("_x", "_y", "_z", "_chords", "_winner", "zones")


def _zone_side(level: int) -> float:
    """Degrees. Sides differ by powers of two, so a cell's children are just those with its index in their upper bits."""
    return S.ZONE_CELL_DEGREES * 2.0 ** (ZONE_BITS * (PLACED - level))


def _zone_cell(df: DataFrame, level: int | Column = PLACED) -> DataFrame:
    """Add the grid cell (`_row`, `_col`) of each place; all rows without a place share one cell of their own."""
    side = F.lit(_zone_side(level)) if isinstance(level, int) else F.get(F.array(*[F.lit(_zone_side(i)) for i in range(ZONE_LEVELS)]), level)

    def index(degrees: Column) -> Column:
        return F.floor(degrees / side).cast("bigint")

    lat, lon = F.col("latitude"), F.col("longitude")
    usable = (F.abs(lat) < 1e9) & (F.abs(lon) < 1e9)
    nowhere = F.lit(NO_CELL).cast("bigint")
    return df.withColumns(
        {name: F.when(usable, index(value)).otherwise(nowhere) for name, value in (("_row", lat), ("_col", lon))}
    )


def _raised(levels: int) -> list[Column]:
    """The cell that holds a cell, so many levels up."""
    return [F.shiftright(name, ZONE_BITS * levels).alias(name) for name in ("_row", "_col")]


def _square(a: Column, b: Column) -> Column:
    dx, dy, dz = a.x - b.x, a.y - b.y, a.z - b.z
    return dx * dx + dy * dy + dz * dz


def _measured(cells: DataFrame, level: int) -> DataFrame:
    """Add `_measured`: the `zones` of a cell with their squared chord to its centre."""
    side = F.lit(_zone_side(level))
    x, y, z = _unit_vector((F.col("_row") + 0.5) * side, (F.col("_col") + 0.5) * side)
    centred = cells.withColumn("_centre", F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
    chords = F.transform("zones", lambda zone: F.struct(_square(zone, F.col("_centre")).alias("chord"), zone.alias("zone")))
    return centred.withColumn("_measured", chords)


def _unbeaten(measured: str, best: str, level: int) -> Column:
    """Of measured zones those that may be nearer to some place of the cell than its `best` zone.

    A place p is less than `reach` from the centre c, and for zones w and z, |p-z|^2 - |p-w|^2 differs from its value at c
    by at most 2 |p-c| |z-w|. So z is beaten by w in the whole cell if it is behind by more than that at the centre.
    """
    # half a diagonal, and a little more for rounding
    reach = math.radians(_zone_side(level)) * 0.7072 + 5e-8
    w = F.col(best)

    def stays(m: Column) -> Column:
        behind = m.chord - w.chord
        beaten = (behind > 2.0 * reach * F.sqrt(_square(m.zone, w.zone)) + 1e-14) | (F.isnan(m.chord) & ~F.isnan(w.chord))
        return ~beaten

    return F.transform(F.filter(measured, stays), lambda m: m.zone)


def _shortened(met: DataFrame, level: int, per_row: int, most: int) -> DataFrame:
    """Cells (`_row`, `_col`) with the blocks of zones they met, cut to the unbeaten ones: (..., zone_block, _split, zones).

    Lists of at most `most` zones become one block; on the last level, all do. The others are marked `_split`.
    """
    own = ["device_id", "_row", "_col"]
    cell = Window.partitionBy(*own)
    nearest = F.min(F.array_min("_measured")).over(cell)
    kept = (
        _measured(met, level)
        .withColumn("_best", nearest)
        .select(*own, "zone_block", _unbeaten("_measured", "_best", level).alias("zones"))
        .where(F.size("zones") > 0)
    )
    before = F.sum(F.size("zones")).over(cell.orderBy("zone_block")) - F.size("zones")
    split = F.lit(False) if level == ZONE_LEVELS - 1 else F.sum(F.size("zones")).over(cell) > most
    counted = kept.withColumns({"_before": before, "_split": split})
    block = F.when(F.col("_split"), F.floor(F.col("_before") / F.lit(per_row))).otherwise(F.lit(0).cast("bigint"))
    return (
        counted.groupBy(*own, "_split", block.alias("zone_block")).agg(F.flatten(F.collect_list("zones")).alias("zones"))
    )


def cell_zones(
    places: DataFrame, zones: DataFrame, per_row: int = S.ZONES_PER_ROW, most: int = S.ZONES_PER_CELL
) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Cells that cover the places of a device, with the zones that are nearest to some place in them, and the cells split.

    The first table is (device_id, _level, _row, _col, zones); the others are the split cells of each level, from `PLACED`
    on: a place is listed under the cell of the first level that is not split there. Cells go from coarse to fine, and a
    cell meets only the zones that its parent could not rule out, in arrays of at most about `per_row`. Only cells that still
    list more than `most` zones are cut, and only children that hold places count. So the work grows with the zones and
    the cells, not with their product, and the list a place is compared with does not grow with the zones around it.
    Zones within centimetres of each other share the last cell.
    """
    own = ["device_id", "_row", "_col"]
    blocks = tabled(zone_arrays(zones, per_row))
    cells = tabled(_zone_cell(places).where(F.col("_row") != F.lit(NO_CELL)).select(*own).distinct())
    # without a place, only the zone of the lowest id is wanted
    first = F.array(F.min(F.get("zones", F.lit(0)))).alias("zones")
    nowhere = [F.lit(NO_CELL).cast("bigint").alias(name) for name in ("_row", "_col")]
    listed = [blocks.groupBy("device_id").agg(first).select("device_id", F.lit(PLACED).alias("_level"), *nowhere, "zones")]
    split, parents, up = {}, blocks, ["device_id"]
    for level in range(ZONE_LEVELS):
        if level <= PLACED:
            here = cells.select("device_id", *_raised(PLACED - level)).distinct()
        else:
            here = _zone_cell(places, level).select(*own)
        here = here.withColumns({f"_up{name}": column for name, column in zip(own[1:], _raised(1), strict=True)})
        if level > PLACED:
            here = here.join(parents.select(*up), up, "left_semi").distinct()
        met = here.join(parents, up).select(*own, "zone_block", "zones")
        table = tabled(_shortened(met, level, per_row, most))
        done = table.where(~F.col("_split")).select(*own, "zones")
        if level < PLACED:
            raised = cells.withColumns({f"_up{name}": c for name, c in zip(own[1:], _raised(PLACED - level), strict=True)})
            done = done.withColumnsRenamed({"_row": "_up_row", "_col": "_up_col"})
            fine = _measured(raised.join(done, ["device_id", "_up_row", "_up_col"]), PLACED)
            fine = fine.withColumn("_best", F.array_min("_measured"))
            done = fine.select(*own, _unbeaten("_measured", "_best", PLACED).alias("zones"))
        listed.append(done.select("device_id", F.lit(max(level, PLACED)).alias("_level"), "_row", "_col", "zones"))
        parents, up = table.where("_split").drop("_split"), ["device_id", "_up_row", "_up_col"]
        parents = parents.withColumnsRenamed({"_row": "_up_row", "_col": "_up_col"})
        if parents.isEmpty():
            break
        if level >= PLACED:
            split[level] = table.where("_split AND zone_block = 0").select(*own)  # one row per cell
    table = reduce(DataFrame.unionByName, listed).withColumn("zones", F.array_sort("zones"))
    # Spark knows the size of a stored table: if small it is broadcast, and busy cells are not one task each
    return tabled(table), split


def nearest_zone(
    points: DataFrame, zones: DataFrame, per_row: int = S.ZONES_PER_ROW, places: DataFrame | None = None
) -> DataFrame:
    """Zone context of every point: the nearest zone of its device.

    One plan for any number of zones: a point meets the few zones that `cell_zones` lists for its cell, in one array
    row, so points are neither multiplied nor grouped and need no key. `places` may name a cheaper source of the
    points' (device_id, latitude, longitude), where the points are the outcome of long work; it is read more than once.
    """
    listed, split = cell_zones(points if places is None else places, zones, per_row)
    rows, own = points.withColumn("_level", F.lit(PLACED)), ["device_id", "_row", "_col"]
    for level, cells in split.items():
        known = _zone_cell(rows, level).join(cells.withColumn("_cut", F.lit(1)), own, "left")
        rows = known.withColumn("_level", F.col("_level") + F.coalesce("_cut", F.lit(0))).drop("_row", "_col", "_cut")
    rows = _zone_cell(rows, F.col("_level") if split else PLACED)
    found = with_nearest(rows.join(listed, ["device_id", "_level", "_row", "_col"], "left"), "_best")
    distance = F.col("_best.distance")
    return found.select(
        *points.columns,
        F.col("_best").isNotNull().alias("has_clusters"),
        F.round(distance, 1).alias("min_distance"),
        F.col("_best.cluster_id").alias("nearest_cluster_id"),
        F.col("_best.label").alias("nearest_cluster_label"),
        (distance <= S.INSIDE_ZONE_M).alias("inside_cluster"),
    )

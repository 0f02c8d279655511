"""Exact DBSCAN per device on a grid (after Gan & Tao 2015).

Cells are so small that any two points of one cell are neighbours. A cell with `min_samples` points
therefore holds only core points of one cluster, and its pairs are never formed. Only points of sparse
cells, at most `min_samples - 1` per cell, look at the cells around them, so the candidate pairs grow
linearly with the points. Clusters are the connected components of cells with core points.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions.geo import haversine_m
from waymark.operators.components import connected_components
from waymark.session import shared_dir, tabled

_OFFSET = 1 << 20
_SPAN = 1 << 21


def _row_height(eps_m: float) -> float:
    """Degrees of latitude per cell: eps / sqrt(2), a little less to be safe on the sphere."""
    return math.degrees(eps_m / math.sqrt(2.0) * 0.999 / S.EARTH_RADIUS_M)


def _column_width(row: Column, eps_m: float) -> Column:
    """Degrees of longitude per cell of a row, so that the row's widest side is not longer than its height."""
    height = _row_height(eps_m)
    nearest_equator = F.when(row >= 0, row * height).otherwise((row + 1) * height)
    return F.lit(height) / F.greatest(F.cos(F.radians(nearest_equator)), F.lit(0.01))


def _cell(row: Column, column: Column) -> Column:
    return (row + _OFFSET) * _SPAN + (column + _OFFSET)


def with_cell(points: DataFrame, eps_m: float) -> DataFrame:
    row = F.floor(F.col("latitude") / F.lit(_row_height(eps_m)))
    column = F.floor(F.col("longitude") / _column_width(F.col("_row"), eps_m))
    return points.withColumn("_row", row).withColumn("cell", _cell(F.col("_row"), column))


def _around(df: DataFrame, south: str, north: str, west: str, east: str, eps_m: float) -> DataFrame:
    """One row per cell within `eps_m` of a box, as `cell`."""
    height = _row_height(eps_m)
    reach = math.degrees(eps_m * 1.001 / S.EARTH_RADIUS_M)
    rows = F.sequence(
        F.floor((F.col(south) - reach) / height).cast("bigint"), F.floor((F.col(north) + reach) / height).cast("bigint")
    )
    farthest = F.greatest(F.abs(F.col(south)), F.abs(F.col(north))) + reach
    slant = F.cos(F.radians(farthest))
    margin = F.when((farthest < 90.0) & (slant > 0.01), F.lit(reach) / slant).otherwise(F.lit(360.0))
    spread = df.withColumn("_margin", margin).withColumn("_around", F.explode(rows))
    width = _column_width(F.col("_around"), eps_m)

    def columns(shift: float) -> Column:
        first = F.greatest(F.col(west) - F.col("_margin") + shift, F.lit(-180.0))
        last = F.least(F.col(east) + F.col("_margin") + shift, F.lit(180.0))
        cells = F.sequence(F.floor(first / width).cast("bigint"), F.floor(last / width).cast("bigint"))
        return F.when(first <= last, cells).otherwise(F.array().cast("array<bigint>"))

    # the shifted copies reach across the date line
    near = F.array_distinct(F.concat(columns(0.0), columns(360.0), columns(-360.0)))
    return (
        spread.withColumn("_column", F.explode(near))
        .withColumn("cell", _cell(F.col("_around"), F.col("_column")))
        .drop("_margin", "_around", "_column")
    )


def _links(points: DataFrame, eps_m: float, min_samples: int) -> DataFrame:
    """Neighbours of points in sparse cells, summed up per neighbouring cell.

    For a sparse neighbouring cell the neighbours are listed, fewer than `min_samples`; for a dense
    one, whose points are all core, their number is enough.
    """
    probes = points.where(F.col("size") < min_samples).select(
        "device_id",
        F.col("cell").alias("from_cell"),
        F.col("point").alias("from_point"),
        F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lon"),
    )
    spread = _around(probes, "_lat", "_lat", "_lon", "_lon", eps_m)
    distance = haversine_m(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
    return (
        spread.join(points.select("device_id", "cell", "size", "point", "latitude", "longitude"), ["device_id", "cell"])
        .where(distance <= eps_m)
        .groupBy("device_id", "cell", "from_cell", "from_point")
        .agg(
            F.count(F.lit(1)).alias("near"),
            (F.max("size") >= min_samples).alias("dense"),
            F.collect_list(F.when(F.col("size") < min_samples, F.col("point"))).alias("points"),
        )
    )


#: A cell is cut into 4 x 4 parts, these into 4 x 4 again and so on, down to the precision of a coordinate.
_DEPTH = 16
_SIDES = ["south", "north", "west", "east"]


def _boxes(points: DataFrame, depth: int) -> DataFrame:
    """Occupied parts of dense cells at a depth, with the part around them and the box of their points."""
    part, around = [
        [F.shiftright(name, 2 * (_DEPTH - level)) if level else F.lit(0).cast("bigint") for name in ("_y", "_x")]
        for level in (depth, depth - 1)
    ]
    return points.groupBy(
        "device_id", "cell", around[0].alias("up_y"), around[1].alias("up_x"), part[0].alias("part_y"), part[1].alias("part_x")
    ).agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
    )


def _reach(one: str, two: str) -> tuple[Column, Column]:
    """Bounds of the distance in metres between any two points of two boxes; both are exact for boxes of one point."""
    side = {f"{box}_{name}": F.col(f"{box}_{name}") for box in (one, two) for name in _SIDES}
    turns = F.round((side[f"{one}_west"] + side[f"{one}_east"] - side[f"{two}_west"] - side[f"{two}_east"]) / 720.0) * 360.0

    def spans(low: str, high: str, turn: Column) -> tuple[Column, Column]:
        a_low, a_high = side[f"{one}_{low}"], side[f"{one}_{high}"]
        b_low, b_high = side[f"{two}_{low}"] + turn, side[f"{two}_{high}"] + turn
        return F.greatest(b_low - a_high, a_low - b_high, F.lit(0.0)), F.greatest(a_high - b_low, b_high - a_low)

    def cosines(box: str) -> tuple[Column, Column]:
        south, north = side[f"{box}_south"], side[f"{box}_north"]
        farthest = F.greatest(F.abs(south), F.abs(north))
        nearest = F.when((south <= 0.0) & (north >= 0.0), F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(north)))
        return F.cos(F.radians(farthest)), F.cos(F.radians(nearest))

    lat, lon, cos_one, cos_two = spans("south", "north", F.lit(0.0)), spans("west", "east", turns), cosines(one), cosines(two)

    def metres(end: int) -> Column:
        half_lat, half_lon = F.sin(F.radians(lat[end]) / 2.0), F.sin(F.radians(F.least(lon[end], F.lit(180.0))) / 2.0)
        a = half_lat * half_lat + cos_one[end] * cos_two[end] * half_lon * half_lon
        return F.lit(2.0 * S.EARTH_RADIUS_M) * F.nanvl(F.asin(F.sqrt(a)), F.lit(math.pi / 2.0))

    return metres(0), metres(1)


def _dense_edges(points: DataFrame, eps_m: float, min_samples: int) -> DataFrame:
    """Pairs of dense cells that hold points within `eps_m` of each other.

    The boxes of two cells tell most pairs: all points near, or none. The others are decided by the boxes of parts, of
    parts of parts and so on: a pair of parts that is surely near decides its pair of cells, one that is surely far is
    dropped. While no pair of parts is surely near, all points are nearly `eps_m` apart or more, so only parts along the
    sides that face each other stay, and the work grows with the occupied parts, not with pairs of points.
    """
    fine = _row_height(eps_m) / 4.0**_DEPTH
    dense = points.where(F.col("size") >= min_samples)
    dense = dense.select("device_id", "cell", "latitude", "longitude").distinct()
    dense = dense.withColumns(
        {"_y": F.floor(F.col("latitude") / fine).cast("bigint"), "_x": F.floor(F.col("longitude") / fine).cast("bigint")}
    )
    dense = tabled(dense)

    def named(boxes: DataFrame, cell: str) -> DataFrame:
        own = [F.col(c).alias(f"{cell}_{c}") for c in (*_SIDES, "up_y", "up_x", "part_y", "part_x")]
        return boxes.select(F.col("device_id"), F.col("cell").alias(cell), *own)

    def judged(pairs: DataFrame) -> DataFrame:
        least, most = _reach("a", "b")
        near = pairs.withColumns({"_least": least, "_most": most}).where(F.col("_least") <= eps_m)
        kept = near.select(
            "device_id", "a", "b", "a_part_y", "a_part_x", "b_part_y", "b_part_x", (F.col("_most") <= eps_m).alias("sure")
        )
        return tabled(kept)

    cells = tabled(
        dense.groupBy("device_id", "cell").agg(
            F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"),
            F.max("longitude").alias("east"),
        ).withColumns({name: F.lit(0).cast("bigint") for name in ("up_y", "up_x", "part_y", "part_x")})
    )
    around = _around(named(cells, "a"), "a_south", "a_north", "a_west", "a_east", eps_m)
    met = around.join(named(cells, "b").withColumn("cell", F.col("b")), ["device_id", "cell"])
    state = judged(met.where(F.col("a") < F.col("b")).drop("cell").distinct())
    found = []
    for depth in range(1, _DEPTH + 1):
        sure = state.where("sure").select("device_id", "a", "b").distinct()
        found.append(sure)
        open_ = state.where("NOT sure").join(sure, ["device_id", "a", "b"], "left_anti").drop("sure")
        open_ = tabled(open_)
        if open_.isEmpty():
            break
        boxes = _boxes(dense, depth)
        pairs = open_
        for cell in ("a", "b"):
            parts = named(boxes, cell).withColumnsRenamed({f"{cell}_up_y": f"_{cell}_y", f"{cell}_up_x": f"_{cell}_x"})
            pairs = pairs.withColumnsRenamed({f"{cell}_part_y": f"_{cell}_y", f"{cell}_part_x": f"_{cell}_x"})
            pairs = pairs.join(parts, ["device_id", cell, f"_{cell}_y", f"_{cell}_x"])
        state = judged(pairs)
    else:  # parts as small as a coordinate: what they hold is nearly one place
        one, two = [
            dense.select("device_id", F.col("cell").alias(c), F.col("_y").alias(f"{c}_part_y"), F.col("_x").alias(f"{c}_part_x"),
                         F.col("latitude").alias(f"_{c}_lat"), F.col("longitude").alias(f"_{c}_lon"))
            for c in ("a", "b")
        ]
        left = state.where("NOT sure")
        for side, cell in ((one, "a"), (two, "b")):
            left = left.join(side, ["device_id", cell, f"{cell}_part_y", f"{cell}_part_x"])
        distance = haversine_m(F.col("_a_lat"), F.col("_a_lon"), F.col("_b_lat"), F.col("_b_lon"))
        found += [state.where("sure").select("device_id", "a", "b"), left.where(distance <= eps_m).select("device_id", "a", "b")]
    return reduce(DataFrame.unionByName, found).distinct()


def dbscan(points: DataFrame, eps_m: float = S.EPS_M, min_samples: int = S.MIN_SAMPLES) -> DataFrame:
    """Add `cluster` to points (device_id, point, latitude, longitude, ...): 0.. per device, -1 for noise.

    `point` identifies a point within its device and gives the input order (a time, say). Clusters are
    numbered by their first core point; a border point joins the lowest-numbered cluster next to it.
    """
    shared_dir(points.sparkSession)
    celled = with_cell(points, eps_m)
    sizes = celled.groupBy("device_id", "cell").agg(F.count(F.lit(1)).alias("size"))
    located = celled.drop("_row").join(sizes, ["device_id", "cell"]).checkpoint()
    links = _links(located, eps_m, min_samples).checkpoint()

    from_point = ["device_id", "from_cell", "from_point"]
    sparse_core = (
        links.groupBy(*from_point)
        .agg(F.sum("near").alias("near"))
        .where(F.col("near") >= min_samples)
        .select("device_id", F.col("from_cell").alias("cell"), F.col("from_point").alias("point"))
        .checkpoint()
    )
    dense = located.where(F.col("size") >= min_samples)
    core = dense.select("device_id", "cell", "point").unionByName(sparse_core)
    cells = core.groupBy("device_id", F.col("cell").alias("node")).agg(F.min("point").alias("first_point"))

    # cells with a core neighbour, for every point of a sparse cell
    to_sparse = (
        links.where(~F.col("dense"))
        .select(*from_point, "cell", F.explode("points").alias("point"))
        .join(sparse_core, ["device_id", "cell", "point"], "left_semi")
        .select(*from_point, "cell")
    )
    to_core = links.where("dense").select(*from_point, "cell").unionByName(to_sparse).distinct()
    is_core = sparse_core.select(
        "device_id", F.col("cell").alias("from_cell"), F.col("point").alias("from_point")
    )
    sparse_edges = to_core.join(is_core, from_point, "left_semi").select(
        "device_id", F.col("from_cell").alias("a"), F.col("cell").alias("b")
    )
    edges = sparse_edges.unionByName(_dense_edges(located, eps_m, min_samples))

    parts = connected_components(cells, edges, ["device_id"]).checkpoint()
    by_first = Window.partitionBy("device_id").orderBy("first_point")
    numbers = (
        parts.groupBy("device_id", "root")
        .agg(F.min("first_point").alias("first_point"))
        .withColumn("cluster", (F.row_number().over(by_first) - 1).cast("int"))
        .select("device_id", "root", "cluster")
    )
    cell_cluster = parts.join(numbers, ["device_id", "root"]).select("device_id", F.col("node").alias("cell"), "cluster")

    reached = (
        to_core.join(is_core, from_point, "left_anti")
        .join(cell_cluster, ["device_id", "cell"])
        .groupBy(*from_point)
        .agg(F.min("cluster").alias("_border"))
        .select("device_id", F.col("from_cell").alias("cell"), F.col("from_point").alias("point"), "_border")
    )
    core_flag = sparse_core.withColumn("_sparse_core", F.lit(True))
    own = F.when((F.col("size") >= min_samples) | F.col("_sparse_core"), F.col("_own"))
    return (
        located.join(cell_cluster.withColumnRenamed("cluster", "_own"), ["device_id", "cell"], "left")
        .join(core_flag, ["device_id", "cell", "point"], "left")
        .join(reached, ["device_id", "cell", "point"], "left")
        .select(*points.columns, F.coalesce(own, "_border", F.lit(-1)).alias("cluster"))
    )

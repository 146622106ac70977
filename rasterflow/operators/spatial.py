"""Footprints, reprojection, zonal joins and statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import counted_median, fresh, row_hash

#: The WGS 84 ellipsoid and the UTM grid.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def footprint(transform: Column, height: Column, width: Column) -> Column:
    """The ring of a raster's corners in its own coordinates, from the affine ``[a, b, c, d, e, f]``."""
    a, c, e, f = (transform[i] for i in (0, 2, 4, 5))
    right, bottom = c + a * width, f + e * height
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(c, f), corner(right, f), corner(right, bottom), corner(c, bottom), corner(c, f))


def utm_zone(crs: Column) -> Column:
    """Zone (negative in the south) of an EPSG code like ``EPSG:32631`` or ``+init=epsg:32631``; others raise an error."""
    code = F.regexp_extract(F.lower(crs), r"^(?:\+init=)?epsg:(\d+)$", 1).try_cast("int")
    return F.when(code.between(32601, 32660), code - 32600).when(code.between(32701, 32760), -(code - 32700)).otherwise(F.raise_error(F.concat(F.lit("not a UTM grid: "), F.coalesce(crs, F.lit("null")))).cast("int"))


def utm_to_lonlat(x: Column, y: Column, zone: Column) -> Column:
    """Struct ``(lon, lat)`` in degrees, by the inverse series of the transverse Mercator projection in n (to n^4)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    north = F.when(zone < 0, y - FALSE_NORTH).otherwise(y)
    xi, eta = north / (SCALE * radius), (x - FALSE_EAST) / (SCALE * radius)
    xi1, eta1 = xi, eta
    for k, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta1 = eta1 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * chi)
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (F.abs(zone) * 6 - 183)
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring, by the number of edges to its right; lower and left edges belong to it."""
    edges = F.sequence(F.lit(1), F.size(ring) - 1)

    def crosses(i: Column) -> Column:
        p, q = F.element_at(ring, i), F.element_at(ring, i + 1)
        spans = (p["y"] <= y) != (q["y"] <= y)
        return spans & (x < p["x"] + F.try_divide(y - p["y"], q["y"] - p["y"]) * (q["x"] - p["x"]))

    hits = F.aggregate(edges, F.lit(0), lambda n, i: n + F.coalesce(crosses(i), F.lit(False)).cast("int"))
    return F.when(F.size(ring) > 1, hits % 2 == 1).otherwise(F.lit(False))


#: A cell with more than this share of all rows of a side is dealt to several tasks.
HOT_SHARE = 1 / 1024


def box_level(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The level of a box: the smallest power of two that its longer side fits into.

    A cell of a level is as wide as 2 to the level, so a box meets at most four cells of its
    own level. Sides below 2 to the -40 of the coordinates count as so long, and cell
    numbers stay below 2 to the 41.
    """
    side, far = F.greatest(x1 - x0, y1 - y0), F.greatest(*[F.abs(v) for v in (x0, x1, y0, y1)])
    up = lambda v: F.ceil(F.log2(v)).cast("int")
    # the logarithm may be one off next to a power of two
    level = F.when(F.pow(F.lit(2.0), up(side)) < side, up(side) + 1).otherwise(up(side))
    return F.coalesce(F.greatest(level, up(far) - 40), F.lit(0))


def cell_at(level: Column, x: Column, y: Column) -> Column:
    at = lambda v: F.floor(v / F.pow(F.lit(2.0), level)).cast("long")
    return F.struct(level.alias("level"), at(x).alias("cx"), at(y).alias("cy"))


def box_cells(level: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Cells of a level, its own or a higher one, that a box meets: its corners', at most four."""
    return F.array_distinct(F.array(*[cell_at(level, x, y) for x in (x0, x1) for y in (y0, y1)]))


def deal_cells(left: DataFrame, right: DataFrame, cell: str, lane: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``cell`` with a further key ``lane``, so that crowded cells are shared by many tasks.

    A cell that holds more than ``HOT_SHARE`` of the rows of a side is cut into lanes, in
    proportion: its rows of that side are dealt to them by a digest and the partition that
    they come from (so equal rows of one partition stay together), and the other side's rows
    are repeated for each. All other cells have one
    lane. There are at most ``1 / HOT_SHARE`` such cells for each side, in a broadcast table.
    """
    names = fresh(left.select("*", *[F.lit(0).alias(c) for c in right.columns if c not in left.columns]), "_n", "_all", "_lanes_l", "_lanes_r", "_hot", "_mine", "_theirs")
    n, total, lanes_l, lanes_r, hot, mine, theirs = names

    def crowded(df: DataFrame, lanes: str) -> DataFrame:
        counts = df.groupBy(F.col(cell).alias(hot)).agg(F.count("*").alias(n))
        whole = counts.agg(F.sum(n).alias(total))
        share = F.col(n) / F.col(total) / F.lit(HOT_SHARE)
        return counts.join(F.broadcast(whole), F.lit(True)).where(share > 1).select(hot, F.ceil(share).cast("int").alias(lanes))

    table = F.broadcast(crowded(left, lanes_l).join(crowded(right, lanes_r), hot, "full_outer"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(table, F.col(cell) == F.col(hot), "left")
        at = F.pmod(F.xxhash64(row_hash(df), F.spark_partition_id()), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
        rows = rows.withColumn(mine, at).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return rows

    a, b = dealt(left, lanes_l, lanes_r), dealt(right, lanes_r, lanes_l)
    key = lambda x, y: F.struct(F.col(x).alias("l"), F.col(y).alias("r"))
    drop = (hot, lanes_l, lanes_r, mine, theirs)
    return a.withColumn(lane, key(mine, theirs)).drop(*drop), b.withColumn(lane, key(theirs, mine)).drop(*drop)


def zonal_join(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", ring: str = "ring") -> DataFrame:
    """Points with the polygons that contain them: an equi-join on the cells of a grid of several levels, then the exact test.

    A polygon is filed under the at most four cells of its own size that its bounding box
    meets, whatever its size. A point is looked up in its cell of every level that some
    polygon has. Crowded cells are shared by many tasks. Points with a missing place, and
    rings without corners, are in no row.
    """
    (cell, lane, level, levels, box) = fresh(points.select(*points.columns, *[F.lit(0).alias(c) for c in polygons.columns if c not in points.columns]), "_cell", "_lane", "_level", "_levels", "_box")
    xs, ys = F.transform(ring, lambda p: p["x"].cast("double")), F.transform(ring, lambda p: p["y"].cast("double"))
    ends = F.array(F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys))
    corners = [F.col(box)[i] for i in range(4)]
    known = polygons.withColumn(box, ends).where(F.size(ring) > 1).withColumn(level, box_level(*corners))
    zones = known.withColumn(cell, F.explode(box_cells(F.col(level), *corners))).drop(box, level)
    some = F.broadcast(known.agg(F.collect_set(level).alias(levels)))  # one row, with no more entries than doubles have powers of two
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    there = points.where(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py)).join(some, F.lit(True)).withColumn(level, F.explode(levels))
    probes = there.withColumn(cell, cell_at(F.col(level), px, py)).drop(levels, level)
    left, right = deal_cells(probes, zones, cell, lane)
    return left.join(right, [cell, lane]).where(inside(F.col(ring), F.col(x), F.col(y))).drop(cell, lane)


def zonal_stats(points: DataFrame, polygons: DataFrame, key: str, value: str = "elev", prefix: str = "elevation", x: str = "lon", y: str = "lat", ring: str = "ring") -> DataFrame:
    """Mean, population deviation and exact median of the points in each polygon; null and NaN are no data.

    A polygon may hold any number of points: see :func:`counted_median`.
    """
    joined = zonal_join(points.where(F.col(value).isNotNull()), polygons, x, y, ring).select(key, value)
    stats = counted_median(joined, [key], value, f"{prefix}_median")
    return stats.select(key, F.col("mean").alias(f"{prefix}_mean"), F.col("std").alias(f"{prefix}_std"), f"{prefix}_median")


def boxes_touching(boxes: DataFrame, others: DataFrame, columns: tuple[str, str, str, str] = ("xmin", "xmax", "ymin", "ymax")) -> DataFrame:
    """Rows of ``boxes`` that meet at least one box of ``others``, repeated rows as often as they occur.

    Different boxes are filed under the cells of their own level, four at most. Of two boxes
    that meet, the smaller one meets no more than four cells of the larger one's level; so
    each side looks its boxes up in the levels of the other side's larger boxes, and a pair
    is found from one side or the other. Rows are then kept by their box, whatever their
    other columns are. Boxes with a missing end meet none.
    """
    ends = [F.col(c) for c in ("x0", "x1", "y0", "y1")]
    meet = (F.col("x0") <= F.col("x1_b")) & (F.col("x1") >= F.col("x0_b")) & (F.col("y0") <= F.col("y1_b")) & (F.col("y1") >= F.col("y0_b"))

    def filed(df: DataFrame) -> DataFrame:
        rows = df.select(*[F.col(c).cast("double").alias(e) for c, e in zip(columns, ("x0", "x1", "y0", "y1"), strict=True)]).distinct().dropna()
        return rows.withColumn("level", box_level(*ends))

    mine, theirs = filed(boxes), filed(others)

    def found(small: DataFrame, large: DataFrame, also: bool, keep_small: bool) -> DataFrame:
        """Of each pair that meets, one side: ``small`` looked up in the levels of ``large`` above its own, or also its own."""
        levels = F.broadcast(large.agg(F.collect_set("level").alias("levels")))
        above = lambda v: v >= F.col("level") if also else v > F.col("level")
        probes = small.join(levels, F.lit(True)).withColumn("at", F.explode(F.filter("levels", above))).withColumn("cell", F.explode(box_cells(F.col("at"), *ends))).drop("levels", "at", "level")
        held = large.withColumn("cell", F.explode(box_cells(F.col("level"), *ends))).drop("level").withColumnsRenamed({c: f"{c}_b" for c in ("x0", "x1", "y0", "y1")})
        left, right = deal_cells(probes, held, "cell", "lane")
        both = left.join(right.withColumnsRenamed({"cell": "cell_b", "lane": "lane_b"}), (F.col("cell") == F.col("cell_b")) & (F.col("lane") == F.col("lane_b")) & meet, "left_semi" if keep_small else "inner")
        return both.select("x0", "x1", "y0", "y1") if keep_small else both.select(*[F.col(f"{c}_b").alias(c) for c in ("x0", "x1", "y0", "y1")])

    names = fresh(boxes, *(f"_{k}" for k in range(4)))
    hit = found(mine, theirs, True, True).unionAll(found(theirs, mine, False, False)).distinct().toDF(*names)
    same = [F.col(f"`{c}`").cast("double") == F.col(n) for c, n in zip(columns, names, strict=True)]
    return boxes.join(hit, same, "left_semi")


def lonlat_to_utm(lon: float, lat: float, zone: int) -> tuple[float, float]:
    """The forward projection of one point, for checks."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = math.radians(lat), math.radians(lon - (abs(zone) * 6 - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    east = eta + sum(a * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, a in enumerate(alpha, 1))
    north = xi + sum(a * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, a in enumerate(alpha, 1))
    return FALSE_EAST + SCALE * radius * east, SCALE * radius * north + (FALSE_NORTH if zone < 0 else 0)

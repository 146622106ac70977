"""Tiles of a grid and mosaics of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_step(side: int, window: int) -> tuple[int, int]:
    """Step between tiles and number of tiles along one axis."""
    if not 0 < window <= side:
        raise ValueError("a window must fit into the side")
    step = side // (side // window)
    return step, (side - window) // step + 1


def tile(pixels: DataFrame, side: int, window: int, y: str = "y", x: str = "x") -> DataFrame:
    """Pixels with their tile and place in it; pixels in gaps between tiles are dropped.

    Only whole windows count. The step is never below the window, so tiles don't overlap.
    """
    step, n = tile_step(side, window)
    for axis, column in (("y", y), ("x", x)):
        at = F.col(column).cast("int")
        pixels = pixels.withColumns({f"tile_{axis}": F.floor(at / step).cast("int"), f"d{axis}": (at % step).cast("int")})
    return pixels.where((F.col("dy") < window) & (F.col("dx") < window) & (F.col("tile_y") < n) & (F.col("tile_x") < n))


def gather_tiles(pixels: DataFrame, keys: list[str], value: str = "value", out: str = "values") -> DataFrame:
    """Tiled pixels as one array for each tile, row by row; a tile is bounded by its window."""
    entries = F.array_sort(F.collect_list(F.struct("dy", "dx", F.col(value).alias("v"))))
    return pixels.groupBy(*keys, "tile_y", "tile_x").agg(entries.alias("_e")).select(*keys, "tile_y", "tile_x", F.transform("_e", lambda e: e["v"]).alias(out))


def spread_tiles(tiles: DataFrame, window: int, values: str = "values", out: str = "value") -> DataFrame:
    """The inverse of :func:`gather_tiles`."""
    rest = [c for c in tiles.columns if c != values]
    rows = tiles.select(*rest, F.posexplode(values).alias("_i", out))
    return rows.withColumns({"dy": F.floor(F.col("_i") / window).cast("int"), "dx": (F.col("_i") % window).cast("int")}).drop("_i")


def mosaic(tiled: DataFrame, step: int) -> DataFrame:
    """Tiled pixels back at their places ``y, x`` of the grid."""
    place = {a: F.col(f"tile_{a}") * step + F.col(f"d{a}") for a in ("y", "x")}
    return tiled.withColumns(place).drop("tile_y", "tile_x", "dy", "dx")


def mosaic_rows(tiled: DataFrame, keys: list[str], step: int, value: str = "value") -> DataFrame:
    """Mosaics as one array for each image row."""
    entries = F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v"))))
    return mosaic(tiled, step).groupBy(*keys, "y").agg(entries.alias("_e")).select(*keys, "y", F.transform("_e", lambda e: e["v"]).alias("values"))


def skip_empty(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Tiles with at least one pixel of a class other than the ignored one."""
    return labels.groupBy(*keys).agg(F.max(F.col(label) != 0).alias("_any")).where("_any").drop("_any")

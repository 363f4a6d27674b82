"""Tiles of a web map in a folder, <zoom>/<x>/<y>.png, as one raster: whole tiles around a region, blocks and windows of it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources.raster import decoded_tiles

c = F.col
SIDE = 256
# Fixed values of Web Mercator and of the tile rules.
WORLD, MOST_LATITUDE, LEFT_OVER = 2 * math.pi * 6378137.0, 85.051129, 1e-11


@dataclass(frozen=True)
class Region:
    """The tiles x0 .. x1, y0 .. y1 (inclusive) of a zoom around a box."""

    zoom: int
    x0: int
    x1: int
    y0: int
    y1: int

    @property
    def width(self) -> int:
        return (self.x1 - self.x0 + 1) * SIDE

    @property
    def height(self) -> int:
        return (self.y1 - self.y0 + 1) * SIDE

    @property
    def transform(self) -> tuple[float, ...]:
        """From pixels (column, row) to EPSG:3857."""
        step = WORLD / (1 << self.zoom) / SIDE
        return step, 0.0, self.x0 * SIDE * step - WORLD / 2, 0.0, -step, WORLD / 2 - self.y0 * SIDE * step


def _tile(lon: float, lat: float, zoom: int) -> tuple[int, int]:
    n = 1 << zoom
    s = math.sin(math.radians(max(-MOST_LATITUDE, min(MOST_LATITUDE, lat))))
    x, y = lon / 360 + 0.5, 0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)
    return max(0, min(n - 1, math.floor(x * n))), max(0, min(n - 1, math.floor((y + 1e-14) * n)))


def region(west: float, south: float, east: float, north: float, zoom: int) -> Region:
    """The tiles that a box in degrees reaches into."""
    if not (west < east and south < north):
        raise ValueError("a region has its west before its east and its south below its north")
    x0, y0 = _tile(max(west, -180.0), north, zoom)
    x1, y1 = _tile(min(east, 180.0) - LEFT_OVER, south + LEFT_OVER, zoom)
    return Region(zoom, x0, max(x0, x1), y0, max(y0, y1))


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """zoom, x, y, content of the tile files under a folder; Spark reads it from wherever it reads files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = r"(\d+)/(\d+)/(\d+)\.[A-Za-z]+$"
    parts = [F.regexp_extract("path", name, i + 1).cast("int").alias(n) for i, n in enumerate(("zoom", "x", "y"))]
    return files.where(F.rlike("path", F.lit(name))).select(*parts, "content")


def blocks(found: DataFrame, part: Region, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """x, y, row, col, rgb, empty of a region's tiles (zoom, x, y, content), of those alone that a window (r0, r1, c0, c1) meets.

    A tile that can't be decoded is null and all empty; a black pixel is empty too. Tiles that are
    missing have no row: reading a window counts them as empty.
    """
    r0, r1, c0, c1 = window or (0, part.height, 0, part.width)
    wanted = (c("zoom") == part.zoom) & c("x").between(part.x0 + c0 // SIDE, min(part.x1, part.x0 + (c1 - 1) // SIDE)) & c("y").between(part.y0 + r0 // SIDE, min(part.y1, part.y0 + (r1 - 1) // SIDE))
    out = decoded_tiles(found.where(wanted).select("x", "y", "content"))
    return out.select("x", "y", ((c("y") - part.y0) * SIDE).cast("bigint").alias("row"), ((c("x") - part.x0) * SIDE).cast("bigint").alias("col"), "rgb")


def missing(found: DataFrame, part: Region) -> DataFrame:
    """x, y of the region's tiles that are not there, or can't be decoded."""
    spark = found.sparkSession
    wide = part.x1 - part.x0 + 1
    wanted = spark.range(wide * (part.y1 - part.y0 + 1)).select((part.x0 + c("id") % wide).cast("int").alias("x"), (part.y0 + F.floor(c("id") / wide)).cast("int").alias("y"))
    return wanted.join(blocks(found, part).where("rgb is not null"), ["x", "y"], "left_anti")


def read_window(found: DataFrame, part: Region, r0: int, r1: int, c0: int, c1: int):
    """Pixels [r1 - r0, c1 - c0, 3] of a window, black where there is no tile, and which are valid: one window, in memory."""
    import numpy as np

    out = np.zeros((r1 - r0, c1 - c0, 3), np.uint8)
    for tile in blocks(found, part, (r0, r1, c0, c1)).where("rgb is not null").collect():
        image = np.frombuffer(tile["rgb"], np.uint8).reshape(SIDE, SIDE, 3)
        y0, y1, x0, x1 = max(r0, tile["row"]), min(r1, tile["row"] + SIDE), max(c0, tile["col"]), min(c1, tile["col"] + SIDE)
        out[y0 - r0 : y1 - r0, x0 - c0 : x1 - c0] = image[y0 - tile["row"] : y1 - tile["row"], x0 - tile["col"] : x1 - tile["col"]]
    return out, out.any(axis=2)

"""Web-Mercator tile mathematics as Column expressions: nothing here leaves whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the Web-Mercator tile scheme.
EARTH_RADIUS = 6378137.0
MAX_LATITUDE = 85.051129
MERCATOR_MAX_LATITUDE = 85.05112878
TILE_PIXELS = 256
EDGE_NUDGE = 1e-11
ROW_NUDGE = 1e-14
MAX_TILES = 1 << 24
MAX_ZOOM = 32


def mercator(lon: Column, lat: Column) -> Column:
    """Struct x, y in metres; the poles are at infinity."""
    y = EARTH_RADIUS * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))
    y = F.when(lat <= -90, F.lit(float("-inf"))).when(lat >= 90, F.lit(float("inf"))).otherwise(y)
    return F.struct((F.radians(lon) * EARTH_RADIUS).alias("x"), y.alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    """Struct lon, lat in degrees."""
    lat = F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - F.pi() / 2)
    return F.struct(F.degrees(x / EARTH_RADIUS).alias("lon"), lat.alias("lat"))


def fraction(lon: Column, lat: Column) -> Column:
    """Struct x, y: the place in the square world, 0 to 1 from its north-west corner."""
    s = F.sin(F.radians(lat))
    return F.struct((lon / 360.0 + 0.5).alias("x"), (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())).alias("y"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def tile(lon: Column, lat: Column, zoom: Column) -> Column:
    """Struct x, y of the tile that holds a point; out-of-range coordinates go to the nearest tile."""
    zoom = F.least(zoom, F.lit(MAX_ZOOM))
    n = F.pow(F.lit(2.0), zoom)
    at = fraction(clamp(lon, -180, 180), clamp(lat, -MAX_LATITUDE, MAX_LATITUDE))
    index = lambda v, nudge: clamp_to(F.floor((v + nudge) * n), n).cast("bigint")
    side = lambda v, nudge: F.when(v <= 0, F.lit(0).cast("bigint")).when(v >= 1, (n - 1).cast("bigint")).otherwise(index(v, nudge))
    return F.struct(side(at["x"], 0.0).alias("x"), side(at["y"], ROW_NUDGE).alias("y"))


def clamp_to(index: Column, n: Column) -> Column:
    return F.least(index.cast("double"), n - 1)


def tile_mercator_bounds(x: Column, y: Column, zoom: Column) -> Column:
    """Struct west, south, east, north in metres."""
    import math

    world = 2 * math.pi * EARTH_RADIUS
    size = F.lit(world) / F.pow(F.lit(2.0), zoom)
    west, north = x * size - world / 2, F.lit(world / 2) - y * size
    return F.struct(west.alias("west"), (north - size).alias("south"), (west + size).alias("east"), north.alias("north"))


def edge_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def edge_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


def range_bounds(x0: Column, y0: Column, x1: Column, y1: Column, zoom: Column) -> Column:
    """Struct west, south, east, north in degrees of an inclusive range of tiles."""
    return F.struct(edge_lon(x0, zoom).alias("west"), edge_lat(y1 + 1, zoom).alias("south"), edge_lon(x1 + 1, zoom).alias("east"), edge_lat(y0, zoom).alias("north"))


def tile_bounds(x: Column, y: Column, zoom: Column) -> Column:
    return range_bounds(x, y, x, y, zoom)


def checked_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """'' or what is wrong with a box."""
    no_number = F.isnan(west) | F.isnan(south) | F.isnan(east) | F.isnan(north)
    return F.when(no_number, F.lit("not a number")).when(south > north, F.lit("south above north")).otherwise(F.lit(""))


def tile_range(west: Column, south: Column, east: Column, north: Column, zoom: Column) -> Column:
    """Struct x0, y0, x1, y1: the inclusive cover of a box; a box on a tile's edge doesn't pull in the next tile."""
    low = tile(F.greatest(west, F.lit(-180.0)), F.least(north, F.lit(MAX_LATITUDE)), zoom)
    high = tile(F.least(east, F.lit(180.0)) - EDGE_NUDGE, F.greatest(south, F.lit(-MAX_LATITUDE)) + EDGE_NUDGE, zoom)
    return F.struct(low["x"].alias("x0"), low["y"].alias("y0"), F.greatest(low["x"], high["x"]).alias("x1"), F.greatest(low["y"], high["y"]).alias("y1"))


def snapped_box(west: Column, south: Column, east: Column, north: Column, zoom: Column) -> Column:
    """The box grown to the edges of its tiles; one that crosses 180 degrees raises."""
    cover = tile_range(west, south, east, north, zoom)
    grown = range_bounds(cover["x0"], cover["y0"], cover["x1"], cover["y1"], zoom)
    return F.when(west > east, F.raise_error(F.lit("a box across 180 degrees must be split"))).otherwise(grown)


def parts_of_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Array of one box, or of two that meet at 180 degrees where west > east."""
    box = lambda w, e: F.struct(w.alias("west"), south.alias("south"), e.alias("east"), north.alias("north"))
    return F.when(west > east, F.array(box(F.lit(-180.0), east), box(west, F.lit(180.0)))).otherwise(F.array(box(west, east)))


def n_tiles(cover: Column) -> Column:
    return (cover["x1"] - cover["x0"] + 1) * (cover["y1"] - cover["y0"] + 1)


def covering_tiles(boxes: DataFrame, zooms: list[int], key: str = "id") -> DataFrame:
    """key, zoom, x, y for each tile that covers a box (west, south, east, north), generated from its range.

    A box with more than MAX_TILES tiles raises before one is generated.
    """
    parts = boxes.select(key, F.inline(parts_of_box(*[F.col(c) for c in ("west", "south", "east", "north")])))
    parts = parts.withColumn("zoom", F.explode(F.array(*[F.lit(int(z)).cast("bigint") for z in zooms])))
    parts = parts.withColumn("cover", tile_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("zoom")))
    within = F.when(n_tiles(F.col("cover")) > MAX_TILES, F.raise_error(F.lit("the box covers too many tiles"))).otherwise(F.col("cover.x1"))
    return parts.withColumn("x", F.explode(F.sequence(F.col("cover.x0"), within))).withColumn("y", F.explode(F.sequence("cover.y0", "cover.y1"))).select(key, "zoom", "x", "y")


def wrapped_sets(tiles: DataFrame, by: str) -> DataFrame:
    """by, widest_gap, wraps: whether a set of tiles (by, zoom, x) sits on both sides of 180 degrees with half the world empty."""
    columns = tiles.groupBy(by, "x").agg(F.min("zoom").alias("zoom"), F.max("zoom").alias("top"))
    gap = F.coalesce(F.lead("x").over(Window.partitionBy(by).orderBy("x")) - F.col("x") - 1, F.lit(0))
    found = columns.withColumn("gap", gap).groupBy(by).agg(F.max("gap").alias("widest_gap"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("zoom").alias("zoom"), F.max("top").alias("top"))
    n = F.pow(F.lit(2.0), F.col("zoom"))
    edges = (F.col("zoom") == F.col("top")) & (F.col("lo") == 0) & (F.col("hi") == n - 1)
    return found.select(by, "widest_gap", (edges & (F.col("widest_gap") > 0) & (F.col("widest_gap") >= F.floor(n / 2))).alias("wraps"))


def grid_transform(x0: Column, y0: Column, zoom: Column) -> Column:
    """Affine struct of the pixel grid whose first tile is (x0, y0)."""
    import math

    world = 2 * math.pi * EARTH_RADIUS
    tile_size = F.lit(world) / F.pow(F.lit(2.0), zoom)
    pixel = tile_size / TILE_PIXELS
    zero = F.lit(0.0)
    return F.struct(pixel.alias("a"), zero.alias("b"), (x0 * tile_size - world / 2).alias("c"), zero.alias("d"), (-pixel).alias("e"), (F.lit(world / 2) - y0 * tile_size).alias("f"))


def ground_resolution(zoom: Column, lat: Column) -> Column:
    """Metres on the ground for a pixel."""
    import math

    return 2 * math.pi * EARTH_RADIUS * F.cos(F.radians(lat)) / (TILE_PIXELS * F.pow(F.lit(2.0), zoom))


def box_km(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Struct width, height in kilometres, about."""
    width = (east - west) * 111.320 * F.cos(F.radians((south + north) / 2))
    return F.struct(width.alias("width"), ((north - south) * 110.574).alias("height"))


def placed_longitudes(west: Column, east: Column) -> Column:
    """Struct west, east, problem: a box given in 0..360 longitudes moved to -180..180, or what is wrong with it."""
    both = (east > 180) & (east <= 360) & (west >= 180) & (west < east)
    over_zero = (west > 180) & (west <= 360) & (east >= 0) & (east <= 180) & (west - 360 < east)
    narrow = east - (west - 360) <= 180
    over_180 = (east > 180) & (east <= 360) & (west >= -180) & (west < 180)
    outside = ~west.between(-180, 180) | ~east.between(-180, 180)
    out = lambda w, e, p: F.struct(w.cast("double").alias("west"), e.cast("double").alias("east"), F.lit(p).alias("problem"))
    none = F.lit(None)
    return (
        F.when(both, out(west - 360, east - 360, ""))
        .when(over_zero & narrow, out(west - 360, east, ""))
        .when(over_zero, out(none, none, "swapped"))
        .when(over_180, out(none, none, "crosses 180"))
        .when(outside, out(none, none, "out of range"))
        .otherwise(out(west, east, ""))
    )


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (zone + F.when(lat >= 0, 32600).otherwise(32700)).cast("bigint")

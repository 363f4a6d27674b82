"""Queries of the tile, affine and coordinate operators, each with the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import affine as A
from geoloom.functions import tiles as T
from geoloom.plans.tables import BOXES, POINTS, boxes, points, sql, table

c = F.col


def rounded(digits: int = 6, **columns: Column) -> list[Column]:
    return [F.round(v, digits).alias(k) for k, v in columns.items()]


def spread(struct: str, names: str, digits: int = 6) -> list[Column]:
    return [F.round(c(f"{struct}.{n}"), digits).alias(n) for n in names.split()]


# SQL of the tile index of (lon, lat) at zoom z, written out for the oracle.
def _x(lon: str, z: str) -> str:
    v = f"(least(greatest({lon}, -180), 180) / 360 + 0.5)"
    return f"CAST(CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= 1 THEN power(2e0, {z}) - 1 ELSE least(floor({v} * power(2e0, {z})), power(2e0, {z}) - 1) END AS BIGINT)"


def _y(lat: str, z: str) -> str:
    s = f"sin(radians(least(greatest({lat}, -85.051129), 85.051129)))"
    v = f"(0.5 - 0.25 * ln((1 + {s}) / (1 - {s})) / pi())"
    return f"CAST(CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= 1 THEN power(2e0, {z}) - 1 ELSE least(floor(({v} + 1e-14) * power(2e0, {z})), power(2e0, {z}) - 1) END AS BIGINT)"


_RANGE = f"ranges AS (SELECT *, {_x('greatest(west, -180)', 'zoom')} AS x0, {_y('least(north, 85.051129)', 'zoom')} AS y0, greatest({_x('greatest(west, -180)', 'zoom')}, {_x('least(east, 180) - 1e-11', 'zoom')}) AS x1, greatest({_y('least(north, 85.051129)', 'zoom')}, {_y('greatest(south, -85.051129) + 1e-11', 'zoom')}) AS y1 FROM boxes)"
_LON = "({x} / power(2e0, zoom) * 360 - 180)"
_LAT = "degrees(atan((exp(pi() * (1 - 2 * {y} / power(2e0, zoom))) - exp(-pi() * (1 - 2 * {y} / power(2e0, zoom)))) / 2))"


def _edges(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"round({_LON.format(x=x0)}, 6) AS west, round({_LAT.format(y=f'({y1} + 1)')}, 6) AS south, round({_LON.format(x=f'({x1} + 1)')}, 6) AS east, round({_LAT.format(y=y0)}, 6) AS north"


def t1_mercator(spark, sf_dir) -> DataFrame:
    m = T.mercator(c("lon"), c("lat"))
    return points(spark, sf_dir).select("id", *rounded(4, x=m["x"], y=m["y"]))


def t2_fraction(spark, sf_dir) -> DataFrame:
    m = T.fraction(c("lon"), c("lat"))
    return points(spark, sf_dir).select("id", *rounded(9, x=m["x"], y=m["y"]))


def t3_tile(spark, sf_dir) -> DataFrame:
    t = T.tile(c("lon"), c("lat"), c("zoom"))
    return points(spark, sf_dir).select("id", t["x"].alias("x"), t["y"].alias("y"))


def t4_tile_mercator_bounds(spark, sf_dir) -> DataFrame:
    df = points(spark, sf_dir).withColumn("t", T.tile(c("lon"), c("lat"), c("zoom")))
    return df.withColumn("b", T.tile_mercator_bounds(c("t.x"), c("t.y"), c("zoom"))).select("id", *spread("b", "west south east north", 3))


def t5_tile_bounds(spark, sf_dir) -> DataFrame:
    df = points(spark, sf_dir).withColumn("t", T.tile(c("lon"), c("lat"), c("zoom")))
    return df.withColumn("b", T.tile_bounds(c("t.x"), c("t.y"), c("zoom"))).select("id", *spread("b", "west south east north"))


def _box(*more: str) -> list[Column]:
    return [c(x) for x in ("west", "south", "east", "north", *more)]


def t6_tile_range(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir).select("id", T.tile_range(*_box("zoom")).alias("r")).select("id", "r.*")


def t7_snapped_box(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir).select("id", T.snapped_box(*_box("zoom")).alias("b")).select("id", *spread("b", "west south east north"))


def crossing(spark, sf_dir) -> DataFrame:
    """Boxes of which some reach over 180 degrees and are written with west > east."""
    return boxes(spark, sf_dir).withColumn("east", F.when(c("id") % 5 == 0, c("west") - 300).otherwise(c("east"))).withColumn("east", F.when(c("east") < -180, c("east") + 360).otherwise(c("east")))


_CROSSING = "crossing AS (SELECT id, west, south, CASE WHEN e < -180 THEN e + 360 ELSE e END AS east, north, zoom FROM (SELECT *, CASE WHEN id % 5 = 0 THEN west - 300 ELSE east END AS e FROM boxes))"


def t8_split_box(spark, sf_dir) -> DataFrame:
    return crossing(spark, sf_dir).select("id", F.inline(T.parts_of_box(*_box()))).select("id", *rounded(west=c("west"), south=c("south"), east=c("east"), north=c("north")))


def t9_tile_count(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir).select("id", T.n_tiles(T.tile_range(*_box("zoom"))).alias("n_tiles"))


def t10_tiles(spark, sf_dir) -> DataFrame:
    return T.covering_tiles(boxes(spark, sf_dir), [5, 7])


def t11_wrapped_sets(spark, sf_dir) -> DataFrame:
    k = c("id") % 97  # the higher a set's number, the farther its points from the meridian
    lon = F.when(c("lon") >= 0, 1).otherwise(-1) * (k * 1.8 + F.abs("lon") * (1 - k / 100))
    df = points(spark, sf_dir).select(k.alias("set"), F.lit(3).cast("bigint").alias("zoom"), lon.alias("lon"), "lat")
    return T.wrapped_sets(df.select("set", "zoom", T.tile(c("lon"), c("lat"), c("zoom"))["x"].alias("x")), "set")


def t12_checked_box(spark, sf_dir) -> DataFrame:
    df = boxes(spark, sf_dir).withColumn("north", F.when(c("id") % 3 == 0, c("south") - 1).when(c("id") % 7 == 0, F.lit(float("nan"))).otherwise(c("north")))
    return df.select("id", T.checked_box(*_box()).alias("problem"))


def t13_grid_transform(spark, sf_dir) -> DataFrame:
    r = T.tile_range(*_box("zoom"))
    return boxes(spark, sf_dir).select("id", T.grid_transform(r["x0"], r["y0"], c("zoom")).alias("t")).select("id", *spread("t", "a b c d e f", 4))


def transforms(spark, sf_dir) -> DataFrame:
    """Some grids of pixels, straight and turned, and one that can't be inverted."""
    k = c("s_suppkey")
    t = A.affine(k % 9 + 1, F.when(k % 3 == 0, (k % 4) / 10.0).otherwise(0.0), k * 10, F.when(k % 3 == 0, (k % 5) / 10.0).otherwise(0.0), F.when(k % 50 == 7, 0.0).otherwise(-(k % 8 + 1) / 2.0), 1000 - k * 3)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), t.alias("t"))


_TRANSFORMS = "transforms AS (SELECT s_suppkey AS id, CAST(s_suppkey % 9 + 1 AS DOUBLE) AS a, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 4) / 1e1 ELSE 0e0 END AS b, CAST(s_suppkey * 10 AS DOUBLE) AS c, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 5) / 1e1 ELSE 0e0 END AS d, CASE WHEN s_suppkey % 50 = 7 THEN 0e0 ELSE -(s_suppkey % 8 + 1) / 2e0 END AS e, CAST(1000 - s_suppkey * 3 AS DOUBLE) AS f FROM supplier)"


def t14_inverse(spark, sf_dir) -> DataFrame:
    return transforms(spark, sf_dir).select("id", A.inverse(c("t")).alias("i")).select("id", *[(F.round(c(f"i.{n}"), 6) + 0.0).alias(n) for n in "abcdef"])


def t15_apply(spark, sf_dir) -> DataFrame:
    p = A.apply(c("t"), c("id") % 31, c("id") % 17)
    return transforms(spark, sf_dir).select("id", *rounded(x=p["x"], y=p["y"]))


def t16_moved(spark, sf_dir) -> DataFrame:
    return transforms(spark, sf_dir).select("id", A.moved(c("t"), c("id") % 31, c("id") % 17).alias("m")).select("id", *spread("m", "a b c d e f"))


def t17_patch_bounds(spark, sf_dir) -> DataFrame:
    return transforms(spark, sf_dir).select("id", A.patch_bounds(c("t"), c("id") % 31, c("id") % 17, F.lit(64)).alias("b")).select("id", *spread("b", "west south east north"))


def t18_snapped_interval(spark, sf_dir) -> DataFrame:
    s = A.snapped_interval(c("west"), c("east"), F.lit(0.25), F.lit(0.5))
    return boxes(spark, sf_dir).select("id", s["low"].alias("low"), s["high"].alias("high"))


def t19_pixel_window(spark, sf_dir) -> DataFrame:
    t = A.affine(F.lit(0.25), F.lit(0.0), F.lit(-100.0), F.lit(0.0), F.lit(-0.25), F.lit(60.0))
    bounds = F.struct(*_box())
    return boxes(spark, sf_dir).select("id", A.pixel_window(bounds, t, F.lit(400), F.lit(800)).alias("w")).select("id", "w.*")


def t20_ground_resolution(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).select("id", *rounded(metres=T.ground_resolution(c("zoom"), c("lat"))))


def t21_box_km(spark, sf_dir) -> DataFrame:
    k = T.box_km(*_box())
    return boxes(spark, sf_dir).select("id", *rounded(width=k["width"], height=k["height"]))


def t22_pixel_metres(spark, sf_dir) -> DataFrame:
    """Ground size of a Web-Mercator pixel: map units over the projection's stretch at its latitude."""
    return points(spark, sf_dir).select("id", *rounded(4, metres=2.0 / F.cosh(T.mercator(c("lon"), c("lat"))["y"] / T.EARTH_RADIUS)))


def t23_placed_longitudes(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    west, east = (k * 41) % 420 - 200.0, (k * 73) % 420 - 50.0
    return table(spark, sf_dir, "supplier").select(k.alias("id"), T.placed_longitudes(west, east).alias("p")).select("id", "p.*")


def t26_utm(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).select("id", T.utm_epsg(c("lon"), c("lat")).alias("epsg"))


def t29_epsg(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    text = F.concat(F.when(k % 4 == 0, "epsg:").when(k % 9 == 0, "CRS:").otherwise("EPSG:"), (k * 977 % 40000).cast("string"), F.when(k % 13 == 0, "x").otherwise(""))
    df = table(spark, sf_dir, "supplier").select(k.alias("id"), A.epsg(text).alias("epsg"))
    return df.select("id", "epsg", A.is_geographic(c("epsg")).alias("geographic"))


def t31_world_file(spark, sf_dir) -> DataFrame:
    p = A.apply(c("t"), F.lit(0.5), F.lit(0.5))
    lines = F.regexp_count(A.world_file(c("t")), F.lit("\n"))
    return transforms(spark, sf_dir).select("id", lines.cast("bigint").alias("n_lines"), *rounded(x=p["x"], y=p["y"]))


def t32_lonlat(spark, sf_dir) -> DataFrame:
    m = T.mercator(c("lon"), c("lat"))
    back = T.from_mercator(m["x"], m["y"])
    return points(spark, sf_dir).select("id", *rounded(6, lon=back["lon"], lat=back["lat"]))


def t33_range_bounds(spark, sf_dir) -> DataFrame:
    r = T.tile_range(*_box("zoom"))
    return boxes(spark, sf_dir).select("id", T.range_bounds(r["x0"], r["y0"], r["x1"], r["y1"], c("zoom")).alias("b")).select("id", *spread("b", "west south east north"))


def r1_alignment(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    fine = A.affine(F.lit(10.0), F.lit(0.0), F.lit(500.0), F.lit(0.0), F.lit(-10.0), F.lit(900.0))
    size = F.when(k % 5 == 0, 15.0).when(k % 6 == 0, 5.0).otherwise((k % 4 + 1) * 10.0)
    other = A.affine(size, F.when(k % 11 == 0, 1.0).otherwise(0.0), 500.0 + (k % 7) * 10 + F.when(k % 8 == 0, 3.0).otherwise(0.0), F.lit(0.0), -size, 900.0 - (k % 3) * 10)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), A.alignment(fine, other).alias("g")).select("id", c("g.problem").alias("problem"), *[F.when(c("g.problem") == "", c(f"g.{n}")).alias(n) for n in ("factor", "row_offset", "col_offset")])


_APPLY = "round(c + {col} * a + {row} * b, 6) AS {x}, round(f + {col} * d + {row} * e, 6) AS {y}"
_POINT_TILE = f"tiles AS (SELECT id, zoom, {_x('lon', 'zoom')} AS x, {_y('lat', 'zoom')} AS y FROM points)"
_WORLD = "(2 * pi() * 6378137)"
_CORNER = "SELECT id, c + (id % 17 + dc * 64) * a + (id % 31 + dr * 64) * b AS x, f + (id % 17 + dc * 64) * d + (id % 31 + dr * 64) * e AS y FROM transforms, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(dr, dc)"
_INVERSE = "CASE WHEN b = 0 AND d = 0 THEN CASE WHEN a <> 0 AND e <> 0 THEN {straight} END WHEN abs(a * e - b * d) > 1e-10 * greatest(abs(a), abs(b), abs(d), abs(e)) ** 2 THEN {turned} END"


def _inverse_sql() -> str:
    det = "(a * e - b * d)"
    parts = {"a": ("1 / a", f"e / {det}"), "b": ("0e0", f"-b / {det}"), "c": ("-c / a", f"(b * f - e * c) / {det}"), "d": ("0e0", f"-d / {det}"), "e": ("1 / e", f"a / {det}"), "f": ("-f / e", f"(d * c - a * f) / {det}")}
    return "SELECT id, " + ", ".join(f"round({_INVERSE.format(straight=s, turned=t)}, 6) + 0e0 AS {n}" for n, (s, t) in parts.items()) + " FROM transforms"


_WINDOW = """SELECT id, greatest(0, CAST(floor((60 - north) / 0.25 + 1e-9) AS BIGINT)) AS row0, least(400, CAST(ceil((60 - south) / 0.25 - 1e-9) AS BIGINT)) AS row1,
greatest(0, CAST(floor((west + 100) / 0.25 + 1e-9) AS BIGINT)) AS col0, least(800, CAST(ceil((east + 100) / 0.25 - 1e-9) AS BIGINT)) AS col1,
(west + 100) / 0.25 < -1e-6 OR (60 - north) / 0.25 < -1e-6 OR (east + 100) / 0.25 > 800 + 1e-6 OR (60 - south) / 0.25 > 400 + 1e-6 AS beyond FROM boxes"""

_LONGITUDES = """SELECT id, CASE WHEN p = '' THEN CASE WHEN (e > 180 AND e <= 360 AND w >= 180 AND w < e) OR (w > 180 AND w <= 360) THEN w - 360 ELSE w END END AS west,
CASE WHEN p = '' THEN CASE WHEN e > 180 THEN e - 360 ELSE e END END AS east, p AS problem
FROM (SELECT *, CASE WHEN e > 180 AND e <= 360 AND w >= 180 AND w < e THEN ''
 WHEN w > 180 AND w <= 360 AND e >= 0 AND e <= 180 AND w - 360 < e THEN CASE WHEN e - (w - 360) <= 180 THEN '' ELSE 'swapped' END
 WHEN e > 180 AND e <= 360 AND w >= -180 AND w < 180 THEN 'crosses 180'
 WHEN w < -180 OR w > 180 OR e < -180 OR e > 180 THEN 'out of range' ELSE '' END AS p
FROM (SELECT s_suppkey AS id, CAST((s_suppkey * 41) % 420 - 200 AS DOUBLE) AS w, CAST((s_suppkey * 73) % 420 - 50 AS DOUBLE) AS e FROM supplier))"""

_ALIGN = """SELECT id, problem, CASE WHEN problem = '' THEN CAST(round(s / 10) AS BIGINT) END AS factor, CASE WHEN problem = '' THEN CAST(id % 3 AS BIGINT) END AS row_offset, CASE WHEN problem = '' THEN CAST(id % 7 AS BIGINT) END AS col_offset
FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 'turned' WHEN round(s / 10) < 1 OR abs(s / 10 - round(s / 10)) > 1e-9 THEN 'factor' WHEN id % 8 = 0 THEN 'offset' ELSE '' END AS problem
FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 15e0 WHEN s_suppkey % 6 = 0 THEN 5e0 ELSE (s_suppkey % 4 + 1) * 10e0 END AS s FROM supplier))"""

QUERIES = {
    "t1_mercator": (t1_mercator, sql("SELECT id, round(6378137 * radians(lon), 4) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y FROM points", POINTS)),
    "t2_fraction": (t2_fraction, sql("SELECT id, round(lon / 360 + 0.5, 9) AS x, round(0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi(), 9) AS y FROM points", POINTS)),
    "t3_tile": (t3_tile, sql("SELECT id, x, y FROM tiles", POINTS, _POINT_TILE)),
    "t4_tile_mercator_bounds": (t4_tile_mercator_bounds, sql(f"SELECT id, round(x * s - {_WORLD} / 2, 3) AS west, round({_WORLD} / 2 - (y + 1) * s, 3) AS south, round((x + 1) * s - {_WORLD} / 2, 3) AS east, round({_WORLD} / 2 - y * s, 3) AS north FROM (SELECT *, {_WORLD} / power(2e0, zoom) AS s FROM tiles)", POINTS, _POINT_TILE)),
    "t5_tile_bounds": (t5_tile_bounds, sql(f"SELECT id, {_edges('x', 'y', 'x', 'y')} FROM tiles", POINTS, _POINT_TILE)),
    "t6_tile_range": (t6_tile_range, sql("SELECT id, x0, y0, x1, y1 FROM ranges", BOXES, _RANGE)),
    "t7_snapped_box": (t7_snapped_box, sql(f"SELECT id, {_edges('x0', 'y0', 'x1', 'y1')} FROM ranges", BOXES, _RANGE)),
    "t8_split_box": (t8_split_box, sql("SELECT id, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM (SELECT id, west, south, east, north FROM crossing WHERE west <= east UNION ALL SELECT id, -180, south, east, north FROM crossing WHERE west > east UNION ALL SELECT id, west, south, 180, north FROM crossing WHERE west > east)", BOXES, _CROSSING)),
    "t9_tile_count": (t9_tile_count, sql("SELECT id, (x1 - x0 + 1) * (y1 - y0 + 1) AS n_tiles FROM ranges", BOXES, _RANGE)),
    "t10_tiles": (t10_tiles, sql("SELECT id, zoom, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT id, zoom, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM ranges)", BOXES.replace("boxes AS", "one AS"), "boxes AS (SELECT * REPLACE (CAST(z AS BIGINT) AS zoom) FROM one, (VALUES (5), (7)) AS v(z))", _RANGE)),
    "t11_wrapped_sets": (t11_wrapped_sets, sql(f"SELECT s AS \"set\", CAST(max(gap) AS BIGINT) AS widest_gap, min(x) = 0 AND max(x) = 7 AND max(gap) > 0 AND max(gap) >= 4 AS wraps FROM (SELECT s, x, coalesce(lead(x) OVER (PARTITION BY s ORDER BY x) - x - 1, 0) AS gap FROM (SELECT DISTINCT s, {_x('lon', '3')} AS x FROM (SELECT id % 97 AS s, CASE WHEN lon >= 0 THEN 1 ELSE -1 END * ((id % 97) * 1.8e0 + abs(lon) * (1 - (id % 97) / 1e2)) AS lon FROM points))) GROUP BY s", POINTS)),
    "t12_checked_box": (t12_checked_box, sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'south above north' WHEN id % 7 = 0 THEN 'not a number' ELSE '' END AS problem FROM boxes", BOXES)),
    "t13_grid_transform": (t13_grid_transform, sql(f"SELECT id, round(s / 256, 4) AS a, 0e0 AS b, round(x0 * s - {_WORLD} / 2, 4) AS c, 0e0 AS d, round(-s / 256, 4) AS e, round({_WORLD} / 2 - y0 * s, 4) AS f FROM (SELECT *, {_WORLD} / power(2e0, zoom) AS s FROM ranges)", BOXES, _RANGE)),
    "t14_inverse": (t14_inverse, sql(_inverse_sql(), _TRANSFORMS)),
    "t15_apply": (t15_apply, sql("SELECT id, " + _APPLY.format(col="(id % 31)", row="(id % 17)", x="x", y="y") + " FROM transforms", _TRANSFORMS)),
    "t16_moved": (t16_moved, sql("SELECT id, a, b, " + _APPLY.format(col="(id % 17)", row="(id % 31)", x="c", y="f") + ", d, e FROM transforms", _TRANSFORMS)),
    "t17_patch_bounds": (t17_patch_bounds, sql(f"SELECT id, round(min(x), 6) AS west, round(min(y), 6) AS south, round(max(x), 6) AS east, round(max(y), 6) AS north FROM ({_CORNER}) GROUP BY id", _TRANSFORMS)),
    "t18_snapped_interval": (t18_snapped_interval, sql("SELECT id, 0.25 + floor((west - 0.25) / 0.5 + 1e-9) * 0.5 AS low, 0.25 + ceil((east - 0.25) / 0.5 - 1e-9) * 0.5 AS high FROM boxes", BOXES)),
    "t19_pixel_window": (t19_pixel_window, sql(_WINDOW, BOXES)),
    "t20_ground_resolution": (t20_ground_resolution, sql(f"SELECT id, round({_WORLD} * cos(radians(lat)) / (256 * power(2e0, zoom)), 6) AS metres FROM points", POINTS)),
    "t21_box_km": (t21_box_km, sql("SELECT id, round((east - west) * 111.320e0 * cos(radians((south + north) / 2)), 6) AS width, round((north - south) * 110.574e0, 6) AS height FROM boxes", BOXES)),
    "t22_pixel_metres": (t22_pixel_metres, sql("SELECT id, round(2 * cos(radians(lat)), 4) AS metres FROM points", POINTS)),
    "t23_placed_longitudes": (t23_placed_longitudes, _LONGITUDES),
    "t26_utm": (t26_utm, sql("SELECT id, CAST(least(60, greatest(1, floor((lon + 180) / 6) + 1)) + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS BIGINT) AS epsg FROM points", POINTS)),
    "t29_epsg": (t29_epsg, "SELECT id, epsg, epsg BETWEEN 4000 AND 4999 AS geographic FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 13 <> 0 AND (s_suppkey % 4 = 0 OR s_suppkey % 9 <> 0) AND s_suppkey * 977 % 40000 BETWEEN 1 AND 32766 THEN s_suppkey * 977 % 40000 END AS epsg FROM supplier)"),
    "t31_world_file": (t31_world_file, sql("SELECT id, CAST(6 AS BIGINT) AS n_lines, round(c + (a + b) / 2, 6) AS x, round(f + (d + e) / 2, 6) AS y FROM transforms", _TRANSFORMS)),
    "t32_lonlat": (t32_lonlat, sql("SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points", POINTS)),
    "t33_range_bounds": (t33_range_bounds, sql(f"SELECT id, {_edges('x0', 'y0', 'x1', 'y1')} FROM ranges", BOXES, _RANGE)),
    "r1_alignment": (r1_alignment, _ALIGN),
}

"""Label features on their way to pixels: which are kept, in which places, under which names.

Geometries are parts: polygons of rings of x, y, as the vector readers give them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import tiles as T
from geoloom.functions import utm
from geoloom.operators.shapes import PARTS
from geoloom.sources.vector import nested

c = F.col
POLYGONS, POINTS = ("Polygon", "MultiPolygon"), ("Point", "MultiPoint")
#: Corners of the circle around a point.
CORNERS = 32
_PART_TYPE = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def each_place(parts: Column, change: Callable[[Column], Column]) -> Column:
    """parts with every place (struct x, y) changed."""
    return F.transform(parts, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, change)))


def places(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def bounds(parts: Column) -> Column:
    """Struct minx, miny, maxx, maxy; null without a place."""
    xs, ys = F.transform(places(parts), lambda p: p["x"]), F.transform(places(parts), lambda p: p["y"])
    return F.when(F.size(xs) > 0, F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")))


def to_degrees(parts: Column, epsg: int) -> Column:
    """parts in WGS 84: from degrees, Web Mercator, or a UTM zone's metres."""
    if epsg == 4326:
        return parts
    if epsg == 3857:
        back = lambda p: T.from_mercator(p["x"], p["y"])
    elif 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        back = lambda p: utm.from_utm(p["x"], p["y"], F.lit(epsg))
    else:
        raise ValueError(f"EPSG:{epsg} is not read; features come in 4326, 3857 or a UTM zone")
    return each_place(parts, lambda p: F.struct(back(p)["lon"].alias("x"), back(p)["lat"].alias("y")))


def projected(parts: Column) -> Column:
    """Whether places can't be degrees."""
    return F.exists(places(parts), lambda p: (F.abs(p["x"]) > 360) | (F.abs(p["y"]) > 90))


def skip_counts(labels: DataFrame, label: Column, usable: Column | None = None) -> DataFrame:
    """features, without (no label), and unusable (a label, but no class) of a set of labels."""
    bad = label.isNotNull() & ~usable if usable is not None else F.lit(False)
    return labels.agg(F.count(F.lit(1)).alias("features"), F.count_if(label.isNull()).alias("without"), F.count_if(bad).alias("unusable"))


def kept(features: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """features with class_id, those of class 0 or without a label left out. classes: label, class_id."""
    return features.join(F.broadcast(classes.where("class_id <> 0").withColumnRenamed("label", label)), label)  # at most 255 labels


def require_some(features: DataFrame) -> DataFrame:
    """features, or an error on reading a row count of 0: nothing is left to draw."""
    if not features.limit(1).count():
        raise ValueError("every feature was skipped: none has a label with a class")
    return features


def polygonal(features: DataFrame, points: bool = False) -> DataFrame:
    """Features whose geometry (kind, parts) is polygons, or points where wanted; null geometries are left out."""
    kinds = POLYGONS + (POINTS if points else ())
    return features.where(c("parts").isNotNull() & (c("kind").isin(*kinds) | ((c("kind") == "GeometryCollection") & F.exists("parts", lambda p: F.size(p[0]) > 3))))


def geometry_counts(features: DataFrame, points: bool = False) -> DataFrame:
    """kept, empty and other (lines, and points unless wanted) features."""
    good = c("kind").isin(*POLYGONS, *(POINTS if points else ()), "GeometryCollection")
    there = c("parts").isNotNull()
    return features.agg(F.count_if(there & good).alias("kept"), F.count_if(~there).alias("empty"), F.count_if(there & ~good).alias("other"))


def around(lon: Column, lat: Column, width: float) -> Column:
    """parts of the circle of a width in metres around a point, drawn in its UTM zone: its corners clockwise, places null without a point."""

    def run(lon: pa.Array, lat: pa.Array, epsg: pa.Array) -> pa.Array:
        n = len(lon)
        none = np.asarray(lon.is_null()) | np.asarray(lat.is_null())
        lon, lat, epsg = (v.fill_null(0).to_numpy(zero_copy_only=False) for v in (lon, lat, epsg))
        x, y = (v[:, None] for v in utm.array_to_utm(lon, lat, epsg))
        turn = np.arange(CORNERS) * (-2 * np.pi / CORNERS)
        places = utm.array_from_utm(x + width / 2 * np.cos(turn), y + width / 2 * np.sin(turn), epsg[:, None])
        ring = pa.StructArray.from_arrays([pa.array(v.ravel(), mask=np.repeat(none, CORNERS)) for v in places], ["x", "y"])
        starts = np.arange(n + 1, dtype=np.int32)
        for step in (starts * CORNERS, starts, starts):
            ring = pa.ListArray.from_arrays(pa.array(step), ring)
        return ring

    return F.arrow_udf(run, PARTS)(lon.cast("double"), lat.cast("double"), T.utm_epsg(lon, lat))


def zone_area(ring: Column, epsg: Column) -> Column:
    """Area of a ring in degrees in square metres of a UTM zone, positive if it turns clockwise; null without places."""

    def run(ring: pa.Array, epsg: pa.Array) -> pa.Array:
        n, at = ring.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ring.flatten()
        own = np.repeat(np.arange(len(n)), n)
        lon, lat = (at.field(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (0, 1))
        x, y = utm.array_to_utm(lon, lat, epsg.fill_null(0).to_numpy(zero_copy_only=False)[own])
        first = np.cumsum(n) - n
        after = np.arange(1, len(own) + 1)
        after[(first + n - 1)[n > 0]] = first[n > 0]
        x, y = x - x[first[own]], y - y[first[own]]
        area = np.bincount(own, x * y[after] - x[after] * y, len(n)) / -2
        return pa.array(area, mask=np.isnan(area) | (n == 0) | np.asarray(epsg.is_null()))

    return F.arrow_udf(run, "double")(ring, epsg)


def point_boxes(x: Column, y: Column, side: float) -> Column:
    """Struct x0, y0, x1, y1 of the square around a point, in pixels."""
    return F.struct((x - side / 2).alias("x0"), (y - side / 2).alias("y0"), (x + side / 2).alias("x1"), (y + side / 2).alias("y1"))


def zone_pieces(boxes: DataFrame) -> DataFrame:
    """boxes (west, east, ...) once for each UTM zone they reach into, cut at its sides, with zone."""
    zone = lambda v: F.least(F.greatest(F.floor((v + 180) / 6) + 1, F.lit(1)), F.lit(60))
    each = boxes.withColumn("zone", F.explode(F.sequence(zone(c("west")), zone(c("east")))))
    return each.withColumns({"west": F.greatest("west", c("zone") * 6 - 186.0), "east": F.least("east", c("zone") * 6 - 180.0)}).where("east > west")


def nested_again(features: DataFrame) -> DataFrame:
    """features with parts made of their own rings by nesting: those without area go, a ring inside an even number of others
    is a shell, the others are holes of the smallest one around them. Null where nothing is left."""
    at = features.columns.index("parts")
    schema = ", ".join(f"`{f.name}` {PARTS if f.name == 'parts' else f.dataType.simpleString()}" for f in features.schema)

    def one(parts: list | None) -> list | None:
        rings = []
        for ring in (r for polygon in parts or () for r in polygon):
            places = [(p["x"], p["y"]) for p in ring]
            rings.append(places if not places or places[0] == places[-1] else [*places, places[0]])
        return [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in nested(rings)] or None

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            columns = list(batch.columns)
            columns[at] = pa.array([one(p) for p in columns[at].to_pylist()], _PART_TYPE)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return features.mapInArrow(run, schema)


def assembled(relations: DataFrame) -> DataFrame:
    """id, parts of multipolygon relations (id, ways: lists of places): ways joined at their ends to rings, rings by nesting.

    A way that joins no ring is left out; parts is null without a ring.
    """

    def rings(ways: list[list]) -> list[list]:
        open_, out = [], []
        for way in ([(p["x"], p["y"]) for p in w] for w in ways):
            if len(way) > 3 and way[0] == way[-1]:
                out.append(way)
            elif len(way) > 1:
                open_.append(way)
        while open_:
            line = open_.pop(0)
            while line[0] != line[-1]:
                i = next((i for i, w in enumerate(open_) if line[-1] in (w[0], w[-1])), None)
                if i is None:
                    break
                way = open_.pop(i)
                line = line + (way[1:] if way[0] == line[-1] else way[-2::-1])
            if len(line) > 3 and line[0] == line[-1]:
                out.append(line)
        return out

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            shaped = [nested(rings(ways or [])) for ways in batch.column(1).to_pylist()]
            parts = [[[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in s] or None for s in shaped]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, _PART_TYPE)], ["id", "parts"])

    kind = relations.schema["id"].dataType.simpleString()
    return relations.select("id", c("ways").cast("array<array<struct<x:double,y:double>>>").alias("ways")).mapInArrow(run, f"id {kind}, parts {PARTS}")


def area_names(features: DataFrame, name: str, blank: str = "?") -> DataFrame:
    """features with a usable name: trimmed, `blank` where there is none."""
    return features.withColumn(name, F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(blank)))


def united(sets: Sequence[DataFrame]) -> DataFrame:
    """Label sets in one order, a later set on top: file (its place) and all columns."""
    out = sets[0].withColumn("file", F.lit(0).cast("bigint"))
    for i, more in enumerate(sets[1:], 1):
        out = out.unionByName(more.withColumn("file", F.lit(i).cast("bigint")))
    return out


def misses(boxes: DataFrame, height: int, width: int) -> bool:
    """Whether none of the labels' pixel boxes reaches onto a raster of height x width."""
    return not boxes.where((c("r1") > 0) & (c("r0") < height) & (c("c1") > 0) & (c("c0") < width)).limit(1).count()


def name_problem(name: Column, taken: Sequence[str] = ()) -> Column:
    """Why a class can't have a name where names are listed with spaces between them; null where it can."""
    return F.when(name.isNull() | (F.trim(name) == ""), "is blank").when(F.rlike(name, F.lit(r"\s")), "has a space").when(name.isin(*taken) if taken else F.lit(False), "is taken")

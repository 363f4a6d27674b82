"""Queries of the fetch rules, feature geometry, label rasters, plans, manifests and documents."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import affine
from geoloom.functions import cleaning as C
from geoloom.functions import tiles as T
from geoloom.functions import utm
from geoloom.operators import alignment as AL
from geoloom.operators import burn as B
from geoloom.operators import catalogue as CG
from geoloom.operators import dataset as D
from geoloom.operators import features as FT
from geoloom.operators import fetching as FE
from geoloom.operators import sampling as A
from geoloom.operators import shapes as Z
from geoloom.operators import splits as P
from geoloom.operators import targets as G
from geoloom.plans.catalog import RASTERS, objects, rasters
from geoloom.plans.files import with_bytes
from geoloom.plans.masks import PIXELS, pixels
from geoloom.plans.more import _SPLIT_OF
from geoloom.plans.patches import BURNED, COUNTS, IN_PATCH, MEET, _EDGES, _SHARE, _STAR, labels, patches, shapes
from geoloom.plans.tables import ANCHORS, FEATURES, PATCH, POINTS, SEGMENTS, anchors, features, points, sql, table
from geoloom.sources import png, raster, tiff, vector, wkb, xyz

c = F.col


# --- fetching


def s3_outcomes(spark, sf_dir) -> DataFrame:
    """Tries of a fetch: fine, to be tried again, or failed."""
    e = c("event_id")
    status = F.get(F.array(*[F.lit(x) for x in (200, 204, 404, 429, 500, 503)]), (e % 6).cast("int"))
    body = F.when(e % 5 == 0, F.lit(b"<html>")).otherwise(F.lit(b"\x89PNG\r\n\x1a\n..."))
    problem = F.when(e % 11 == 0, "timeout").when(e % 13 == 0, "network").when(e % 17 == 0, "refused")
    return table(spark, sf_dir, "events").select(e.alias("id"), FE.outcome(status, body, e % 4, problem).alias("outcome"))


def s25_range_reads(spark, sf_dir) -> DataFrame:
    """Byte ranges of one file for each supplier's order lines, in whole blocks."""
    rows = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("file"), (c("l_orderkey") * 5000).alias("offset"), (c("l_quantity") * 400).cast("bigint").alias("length"))
    return FE.range_reads(rows)


def tile_files(spark, sf_dir) -> DataFrame:
    """A tile of one colour for each supplier, a few black or broken."""
    rows = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"))

    def build(r: dict) -> bytes:
        k = r["id"]
        return b"broken" if k % 11 == 0 else png.encode(np.full((256, 256, 3), 0 if k % 7 == 0 else k % 200 + 1, np.uint8))

    k = c("id")
    return with_bytes(rows, build).select(F.lit(12).alias("zoom"), (1000 + k % 10).cast("int").alias("x"), (2000 + F.floor(k / 10)).cast("int").alias("y"), c("data").alias("content"))


REGION = xyz.Region(12, 1001, 1007, 2000, 2999)


def s2_tile_windows(spark, sf_dir) -> DataFrame:
    """Of a window of a region of tiles: where each tile lies, its sum and its valid pixels."""
    found = xyz.blocks(tile_files(spark, sf_dir), REGION, (100, 100_000, 300, 1400))
    level = F.conv(F.hex(F.substring("rgb", 1, 1)), 16, 10).cast("bigint")
    return found.select(c("x").cast("bigint").alias("x"), c("y").cast("bigint").alias("y"), "row", "col", F.octet_length("rgb").cast("bigint").alias("bytes"), level.alias("level"))


def s13_missing_tiles(spark, sf_dir) -> DataFrame:
    """The tiles of a region that have to be fetched again."""
    part = xyz.Region(12, 1001, 1007, 2000, 2000)
    return xyz.missing(tile_files(spark, sf_dir), part).select(c("x").cast("bigint").alias("x"), c("y").cast("bigint").alias("y"))


# --- files


def _patch_bytes(spark, sf_dir, build) -> DataFrame:
    return with_bytes(table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), "embedding"), build)


def _geotiffs(spark, sf_dir) -> DataFrame:
    def build(r: dict) -> bytes:
        k = r["id"]
        return tiff.write(np.array(r["embedding"], np.float32).reshape(8, 8), (0.5, 0.0, float(k), 0.0, -0.5, float(2 * k)), 32600 + k % 60 + 1 if k % 2 else 4326, nodata=-9.0 if k % 3 else None, rows_per_strip=3, deflate=bool(k % 2))

    return _patch_bytes(spark, sf_dir, build).select(c("id").cast("string").alias("path"), c("data").alias("content"))


def s19_headers(spark, sf_dir) -> DataFrame:
    """Headers of GeoTIFFs: size, type, reference system, NoData and corner."""
    found = raster.geotiff_headers(_geotiffs(spark, sf_dir))
    return found.select(c("file").cast("bigint").alias("id"), "height", "width", "dtype", c("epsg").cast("bigint").alias("epsg"), "nodata", c("transform")[2].alias("x"), c("transform")[5].alias("y"), c("transform")[0].alias("step"))


def s22_blocks(spark, sf_dir) -> DataFrame:
    """Blocks of GeoTIFFs of plain and compressed strips, in a window, as pixels."""
    found = raster.pixels(raster.rgb(raster.geotiff_blocks(_geotiffs(spark, sf_dir), side=4, window=(1, 7, 0, 8))))
    return found.groupBy(c("file").cast("bigint").alias("id")).agg(F.count_if("valid").alias("pixels"), F.round(F.sum(c("values")[2]), 5).alias("total"))


def s56_fingerprints(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(c("page_id").cast("string").alias("path"), c("html").cast("binary").alias("content"))
    return raster.fingerprints(pages, 1000).select(c("path").cast("bigint").alias("page_id"), "size", "head_sha256")


def s59_patches(spark, sf_dir) -> DataFrame:
    """Patches from NPY, PNG and TIFF bytes: bands, rows, and sum."""
    suffix = ("npy", "png", "tif")

    def build(r: dict) -> bytes:
        image = (np.array(r["embedding"], np.float64) > 0).astype(np.uint8).reshape(8, 8) * 100
        if r["id"] % 3 == 0:
            out = io.BytesIO()
            np.save(out, image[None])
            return out.getvalue()
        return png.encode(image) if r["id"] % 3 == 1 else tiff.write(image)

    def run(found):
        for batch in found:
            images = [raster.read_patch(x, suffix[i % 3]) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.shape[0] for x in images], pa.int64()), pa.array([int(x[0].sum()) for x in images], pa.int64())], ["id", "bands", "total"])

    return _patch_bytes(spark, sf_dir, build).mapInArrow(run, "id long, bands long, total long")


def i2_cut_short(spark, sf_dir) -> DataFrame:
    """Files that aren't whole: every fourth PNG, TIFF or NPY file has lost its end or its head."""

    def build(r: dict) -> bytes:
        k, image = r["id"], np.array(r["embedding"], np.float32).reshape(1, 8, 8)
        out = io.BytesIO()
        np.save(out, image)
        data = (png.encode((image[0] > 0).astype(np.uint8)), tiff.write(image[0]), out.getvalue())[k % 3]
        return data if k % 4 else data[3:] if k % 8 else data[:-5]

    k = c("id")
    suffix = F.get(F.array(F.lit(".png"), F.lit(".tif"), F.lit(".npy")), (k % 3).cast("int"))
    found = _patch_bytes(spark, sf_dir, build).select(F.concat(k.cast("string"), suffix).alias("path"), c("data").alias("content"))
    return raster.cut_short(found)


def _grid_blocks(spark, sf_dir) -> DataFrame:
    """Embeddings as blocks of 8 x 8 pixels of one raster, twenty side by side; negative pixels aren't valid."""
    data = _patch_bytes(spark, sf_dir, lambda r: np.array(r["embedding"], np.float32).tobytes())
    mask = _patch_bytes(spark, sf_dir, lambda r: (np.array(r["embedding"], np.float32) >= 0).tobytes()).withColumnRenamed("data", "valid")
    k, eight = c("id"), F.lit(8)
    both = data.join(mask, "id")
    return both.select(F.lit("a").alias("file"), (F.floor(k / 20) * 8).alias("row"), (k % 20 * 8).alias("col"), eight.alias("height"), eight.alias("width"), F.lit(1).alias("bands"), F.lit("float32").alias("dtype"), c("data").alias("pixels"), "valid")


def a26_extracted(spark, sf_dir) -> DataFrame:
    """Patches of 12 pixels cut from that raster: valid pixels and their sum."""
    places = table(spark, sf_dir, "part").select(c("p_partkey").alias("patch"), ((c("p_partkey") * 7) % 190).alias("row"), ((c("p_partkey") * 11) % 155).alias("col"))
    found = raster.extracted(_grid_blocks(spark, sf_dir), places, 12)

    def run(batches):
        for batch in batches:
            totals = [float(np.frombuffer(x, np.float32).astype(np.float64).sum()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals)], ["patch", "valid", "total"])

    out = found.select("patch", "pixels", "n_valid").mapInArrow(run, "patch long, valid long, total double")
    return out.select("patch", "valid", F.round("total", 5).alias("total"))


def w27_world_files(spark, sf_dir) -> DataFrame:
    """The world file beside each patch."""
    t = affine.moved(affine.affine(*[F.lit(v) for v in (0.5, 0.0, 100.0, 0.0, -0.5, 900.0)]), c("row"), c("col"))
    return patches(spark, sf_dir).select("patch", D.patch_name(c("patch"), "pgw").alias("name"), affine.world_file(t).alias("text"))


def _located(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).select("id", "lon", "lat")


def _first_places(data: DataFrame, parse) -> DataFrame:
    """id, kind, x, y and name of the first feature that parse finds in each row's bytes."""

    def run(found):
        for batch in found:
            rows = [next(iter(parse(x))) for x in batch.column(1).to_pylist()]
            place = [r[1][0][0][0] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([float(p[0]) for p in place]), pa.array([float(p[1]) for p in place]), pa.array([vector.text_of(r[2].get("name")) for r in rows], pa.string())], ["id", "kind", "x", "y", "name"])

    return data.mapInArrow(run, "id long, kind string, x double, y double, name string").select("id", "kind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "name")


def s42_kml(spark, sf_dir) -> DataFrame:
    """Places as KML in two encodings and back."""

    def build(r: dict) -> bytes:
        code = "iso-8859-1" if r["id"] % 2 else "utf-8"
        text = f'<?xml version="1.0" encoding="{code}"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>\xe9t\xe9 {r["id"]}</name><Point><coordinates>{r["lon"]!r},{r["lat"]!r},0</coordinates></Point></Placemark></Document></kml>'
        return text.encode(code)

    return _first_places(with_bytes(_located(spark, sf_dir), build), vector.parse_kml)


def s44_geopackage(spark, sf_dir) -> DataFrame:
    """A GeoPackage for each supplier, with one layer of two features."""

    def build(r: dict) -> bytes:
        import sqlite3

        with sqlite3.connect(":memory:") as db:
            db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
            db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
            db.execute("INSERT INTO gpkg_contents VALUES ('places', 'features')")
            db.execute("INSERT INTO gpkg_geometry_columns VALUES ('places', 'geom')")
            db.execute("CREATE TABLE places (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
            for i in range(2):
                blob = b"GP\0\x01" + struct.pack("<i", 4326) + wkb.build("Point", [[[(r["id"] + i / 2, -r["id"] / 4)]]])
                db.execute("INSERT INTO places VALUES (?, ?, ?)", (i + 1, blob, f"n{r['id'] % 5}"))
            db.commit()
            return db.serialize()

    rows = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"))
    return _first_places(with_bytes(rows, build), vector.parse_geopackage)


def s47_shapefile(spark, sf_dir) -> DataFrame:
    """Polygons with a hole as shapes and back: kind, rings and their area."""

    def build(r: dict) -> bytes:
        k = r["id"]
        box = lambda x0, y0, x1, y1: [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
        rings = [box(0.0, 0.0, 10.0 + k, 10.0), box(2.0, 2.0, 4.0, 4.0)[::-1], box(100.0 + k, 0.0, 101.0 + k, 3.0)]  # the last one beside the first, however wide that is
        places = [p for ring in rings for p in ring]
        body = struct.pack("<i4d2i3i", 5, 0, 0, 101.0 + k, 10.0, 3, 15, 0, 5, 10) + b"".join(struct.pack("<2d", *p) for p in places)
        record = struct.pack(">2i", 1, len(body) // 2) + body
        return struct.pack(">i20xi", 9994, (100 + len(record)) // 2) + bytes(72) + record

    def run(found):
        for batch in found:
            shapes_ = [next(vector.parse_shapes(x)) for x in batch.column(1).to_pylist()]
            holes = [sum(len(p) - 1 for p in s[1]) for s in shapes_]
            area = [sum(abs(vector.signed_area(p[0])) - sum(abs(vector.signed_area(h)) for h in p[1:]) for p in s[1]) for s in shapes_]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in shapes_]), pa.array([len(s[1]) for s in shapes_], pa.int64()), pa.array(holes, pa.int64()), pa.array(area)], ["id", "kind", "polygons", "holes", "area"])

    rows = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"))
    return with_bytes(rows, build).mapInArrow(run, "id long, kind string, polygons long, holes long, area double")


# --- features


def _squares(x, y, side) -> Column:
    """parts of a square around a place."""
    at = lambda dx, dy: F.struct((x + dx * side).alias("x"), (y + dy * side).alias("y"))
    return F.array(F.array(F.array(*[at(dx, dy) for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5))])))


def l8_polygonal(spark, sf_dir) -> DataFrame:
    """Features whose geometry is polygons: customers with kinds by turns, some without."""
    k = c("c_custkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("Polygon", "Point", "LineString", "MultiPolygon", "GeometryCollection")]), (k % 5).cast("int"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("kind"), F.when(k % 7 != 0, _squares(k, k, 2.0)).alias("parts"))
    return FT.polygonal(rows).select("id", "kind")


def l9_point_areas(spark, sf_dir) -> DataFrame:
    """Circles of 100 m around points: corners, and the area in their own zone."""
    df = points(spark, sf_dir).where("abs(lat) < 80").repartition("id")  # a small file is read by one task, however long its circles take
    df = df.select("id", FT.around(c("lon"), c("lat"), 100.0)[0][0].alias("ring"), T.utm_epsg(c("lon"), c("lat")).alias("epsg"))
    return df.select("id", F.size("ring").cast("bigint").alias("corners"), F.round(FT.zone_area(c("ring"), c("epsg")), 1).alias("area"))


def l14_misses(spark, sf_dir) -> DataFrame:
    """Whether each class has a label on the first 300 x 300 pixels."""
    return AL.any_overlap(labels(spark, sf_dir), ["class_id"], 300, 300)


def l16_nested(spark, sf_dir) -> DataFrame:
    """Rings in any order and direction as polygons with holes; flat ones go."""
    k = c("s_suppkey")
    ring = lambda x0, y0, x1, y1: F.array(*[F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    rings = F.array(ring(3, 3, 4, 4), ring(0, 0, 10, 10), F.when(k % 2 == 0, ring(1, 1, 6, 6)).otherwise(ring(0, 0, 0, 5)), ring(20, 0, 25, 5))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.array(rings).alias("parts"))
    found = FT.nested_again(rows)
    return found.select("id", F.size("parts").cast("bigint").alias("polygons"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.size(p) - 1).alias("holes"))


def l19_names(spark, sf_dir) -> DataFrame:
    """Why names of nations can't be those of classes."""
    return table(spark, sf_dir, "nation").select(c("n_name").alias("name"), FT.name_problem(c("n_name"), ["FRANCE", "CHINA"]).alias("problem"))


def s40_relations(spark, sf_dir) -> DataFrame:
    """Squares in two ways that run against each other, with a closed hole and a loose way: polygons, holes and area."""
    k = c("s_suppkey").cast("double")
    way = lambda *places: F.array(*[F.struct((k + x).alias("x"), F.lit(float(y)).alias("y")) for x, y in places])
    ways = F.array(way((0, 0), (10, 0), (10, 10)), way((2, 2), (4, 2), (4, 4), (2, 4), (2, 2)), way((0, 0), (0, 10), (10, 10)), way((50, 50), (60, 60)))
    rows = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), ways.alias("ways"))
    return areas_of(FT.assembled(rows))


def areas_of(found: DataFrame) -> DataFrame:
    """id, polygons, edges and area of parts, as shapes have them."""
    rows = found.select(c("id").alias("feature"), F.lit(1).cast("bigint").alias("class_id"), "parts")
    areas = Z.shapes(rows).select(c("feature").alias("id"), F.size("edges").cast("bigint").alias("edges"), F.round("area", 6).alias("area"))
    return found.select("id", F.size("parts").cast("bigint").alias("polygons")).join(areas, "id")


def s51_degrees(spark, sf_dir) -> DataFrame:
    """Points in Web Mercator as features in degrees."""
    m = T.mercator(c("lon"), c("lat"))
    rows = points(spark, sf_dir).select("id", F.array(F.array(F.array(F.struct(m["x"].alias("x"), m["y"].alias("y"))))).alias("parts"))
    place = FT.to_degrees(c("parts"), 3857)[0][0][0]
    return rows.select("id", F.round(place["x"], 6).alias("lon"), F.round(place["y"], 6).alias("lat"))


def s53_attributes(spark, sf_dir) -> DataFrame:
    """Attributes of features and how often each value occurs."""
    props = F.create_map(F.lit("segment"), c("c_mktsegment"), F.lit("nation"), F.when(c("c_nationkey") > 3, c("c_nationkey").cast("string")))
    return CG.attributes(table(spark, sf_dir, "customer").select(props.alias("properties")))


# --- label rasters


TURN = (0.8, 0.6, 100.0, 0.6, -0.8, 200.0)
LABEL_GRID = (3.0, 0.0, 90.0, 0.0, -2.0, 400.0)


def r9_turned_lookup(spark, sf_dir) -> DataFrame:
    """Pixel centres of a turned grid found in another one."""
    at = AL.label_pixel(c("row"), c("col"), TURN, LABEL_GRID, 700, 900)
    return patches(spark, sf_dir).select("patch", at.alias("at")).select("patch", "at.r", "at.c")


def r10_other_system(spark, sf_dir) -> DataFrame:
    """Pixel centres in Web Mercator found in a label raster in degrees."""
    at = AL.label_pixel(c("row"), c("col"), (1000.0, 0.0, 1e6, 0.0, -1000.0, 6e6), (0.01, 0.0, 9.0, 0.0, -0.01, 48.0), 1500, 2000, (3857, 4326))
    return patches(spark, sf_dir).select("patch", at.alias("at")).select("patch", "at.r", "at.c")


def g4_label_masks(spark, sf_dir) -> DataFrame:
    """Pixels of patches by the label raster under them, a raster of parts of half the resolution."""
    raster_ = table(spark, sf_dir, "part").select((c("p_partkey") % 3).alias("r"), F.floor(c("p_partkey") / 3).alias("c"), (c("p_size") % 10).cast("bigint").alias("value")).where("c < 3")
    found = AL.label_masks(pixels(spark, sf_dir), raster_, ["id"], (1, 0, 0, 0, 1, 0), (2, 0, 0, 0, 2, 0), (3, 3), {0: 10, 1: 20, 2: 20, 7: 30}, (8, 9))
    return found.groupBy("id", "class_id").agg(F.count(F.lit(1)).alias("pixels"))


# --- shapes


def stars(spark, sf_dir) -> DataFrame:
    """A star of five points for each supplier, as parts."""
    k = c("s_suppkey")
    corner = lambda i: F.struct(F.round((k * 13) % 400 + 30 + 28.25 * F.cos(F.radians(F.lit(144.0) * i + k)), 3).alias("x"), F.round((k * 29) % 400 + 30 + 28.25 * F.sin(F.radians(F.lit(144.0) * i + k)), 3).alias("y"))
    return table(spark, sf_dir, "supplier").select(k.alias("feature"), (k % 5 + 1).alias("class_id"), F.array(F.array(F.array(*[corner(i) for i in range(5)]))).alias("parts"))


def v2_touched(spark, sf_dir) -> DataFrame:
    """Pixels that each star covers or touches."""
    found = B.own_pixels(B.tiles(Z.shapes(stars(spark, sf_dir))), Z.shapes(stars(spark, sf_dir)), B.TILE, all_touched=True)
    return found.groupBy(c("feature").alias("id")).agg(F.sum("area").alias("pixels"))


def v4_edges(spark, sf_dir) -> DataFrame:
    """Shapes of quadrangles on a turned grid: edges, and area in pixels, all clockwise."""
    k = c("s_suppkey").cast("double")
    place = lambda x, y: F.struct((k + x).alias("x"), (y + 0 * k).alias("y"))
    outer, hole = F.array(place(0, 0), place(20, 1), place(18, 15), place(-3, 12)), F.array(place(4, 4), place(8, 4), place(8, 8), place(4, 8), place(4, 4))
    rows = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("feature"), F.lit(1).cast("bigint").alias("class_id"), F.array(F.array(F.when(c("s_suppkey") % 2 == 0, outer).otherwise(F.reverse(outer)), hole)).alias("parts"))
    signed = F.aggregate("edges", F.lit(0.0), lambda a, e: a + (e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2 * F.when(e["w"] > 0, 1).otherwise(0))
    return Z.shapes(rows, (0.5, 0.0, 10.0, 0.0, -0.5, 30.0)).select(c("feature").alias("id"), F.size("edges").cast("bigint").alias("edges"), F.round("area", 6).alias("area"), F.round(signed, 6).alias("outside"), "r0", "r1", "c0", "c1")


def v12_valid_parts(spark, sf_dir) -> DataFrame:
    """What two valid strips of each patch show of boxes: area and bounds."""
    df = patches(spark, sf_dir)
    strips = df.select("patch", F.explode(F.array(*[F.struct(c("row").alias("r0"), (c("row") + PATCH).alias("r1"), (c("col") + a).alias("c0"), (c("col") + b).alias("c1")) for a, b in ((0, 20), (40, 64))])).alias("s")).select("patch", "s.*")
    found = B.seen(B.with_valid(df, strips), shapes(spark, sf_dir), PATCH)
    return found.select("patch", "feature", *[c(x).cast("bigint").alias(x) for x in ("seen", "x0", "x1", "y0", "y1")])


def g16_classification(spark, sf_dir) -> DataFrame:
    found = D.target(spark, "classification", patches(spark, sf_dir), shapes(spark, sf_dir), PATCH, min_fraction=0.02)
    return found.select("patch", "single", F.array_join(c("multi").cast("array<string>"), " ").alias("multi"))


# --- sampling, planning, manifests


def a2_positions(spark, sf_dir) -> DataFrame:
    """Positions on one axis, by strategy."""
    found = rasters(spark, sf_dir).select("id", F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), A.axis(c("width"), F.lit(64).cast("bigint"), F.lit(48).cast("bigint"), s).alias("at")) for s in A.STRATEGIES])))
    return found.select("id", "strategy", F.explode("at").alias("col"))


def a11_defaults(spark, sf_dir) -> DataFrame:
    """A stride of 0 is the patch's size."""
    return A.grid(rasters(spark, sf_dir), 64, 0, "drop")


def a13_short_draws(spark, sf_dir) -> DataFrame:
    """Rasters with fewer places than random patches are wanted."""
    n = A.random_capacity(c("height"), c("width"), F.lit(64), "drop")
    found = rasters(spark, sf_dir).select("id", n.alias("n"))
    return found.select("id", "n", D.short_of(F.least("n", F.lit(5000)), F.lit(5000)).alias("warning")).where("warning is not null")


def a18_windows(spark, sf_dir) -> DataFrame:
    return A.chunks(anchors(spark, sf_dir).select("id", "row", "col"), 512, 900, PATCH).select("id", "chunk", "window")


def a8_generator(spark, sf_dir) -> DataFrame:
    """Two numbers of the generator from each seed, and one below 1000."""

    def run(found):
        for batch in found:
            out = []
            for seed in batch.column(0).to_pylist():
                state, first = A.splitmix(seed)
                _, second = A.splitmix(state)
                out.append((seed, str(first), str(second), second * 1000 >> 64))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["id", "first", "second", "below"])

    return table(spark, sf_dir, "customer").select("c_custkey").mapInArrow(run, "id long, first string, second string, below long")


def m8_sizes(spark, sf_dir) -> DataFrame:
    """Size category and bytes as text."""
    n = F.pow(c("s_suppkey").cast("double"), F.lit(3.0)).cast("bigint")
    return table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), C.size_category(n).alias("category"), C.human_bytes((n * 1000).cast("double")).alias("size"))


def m15_large_jobs(spark, sf_dir) -> DataFrame:
    """Jobs by their tiles, bytes and patches: which are large, and why."""
    k = c("c_custkey")
    tiles, size, n = F.when(k % 3 != 0, k * 37), k * 17_000_000, k * 1700
    return table(spark, sf_dir, "customer").select(k.alias("id"), D.is_large(tiles, size, n).alias("large"), D.large_reason(tiles, size, n).alias("reason"), F.round(D.image_bytes(k % 500 + 1, F.lit(4), F.lit(2), "tif"), 3).alias("image"))


def i7_resumed(spark, sf_dir) -> DataFrame:
    """What a run that was begun has still to do."""
    planned = patches(spark, sf_dir).select("row", "col")
    done = table(spark, sf_dir, "lineitem").select((F.floor(c("l_partkey") / 50) * 64).alias("row"), ((c("l_partkey") % 50) * 48).alias("col"), "l_discount").where("l_discount > 0.08")
    return D.resumed(planned, done, {"size": 64}, {"size": 64})


def p17_resplit(spark, sf_dir) -> DataFrame:
    manifest = anchors(spark, sf_dir).select(c("id").alias("patch"), "row", "col", c("p_brand").alias("stratum"))
    return D.resplit(manifest, "stratified", PATCH)


def p18_geometry(spark, sf_dir) -> DataFrame:
    return D.patch_geometry(patches(spark, sf_dir).withColumn("size", F.lit(PATCH).cast("bigint")))


# --- documents


def w2_source_names(spark, sf_dir) -> DataFrame:
    return D.source_names(patches(spark, sf_dir), ["rgb", "sar"], "tif")


def w14_change_names(spark, sf_dir) -> DataFrame:
    return D.change_names(patches(spark, sf_dir), "png")


def w7_detection_files(spark, sf_dir) -> DataFrame:
    """A label file for each patch, empty where nothing was found."""
    df = patches(spark, sf_dir)
    return D.detection_files(objects(spark, sf_dir), df, dict(enumerate(SEGMENTS, 1)), PATCH, PATCH)


def w11_dataset_yaml(spark, sf_dir) -> DataFrame:
    names = features(spark, sf_dir).select("class_id", "class_name").distinct().collect()  # at most 255 classes
    return spark.createDataFrame([(D.dataset_yaml(dict(names), True),)], "text string")


def w24_card(spark, sf_dir) -> DataFrame:
    """The card's split lines, sizes and classes."""
    df = patches(spark, sf_dir)
    text = D.card("set", df, P.random_split(df, "patch"), {name: i for i, name in enumerate(SEGMENTS, 1)}, ignore=255)
    return spark.createDataFrame([(text,)], "text string").select(F.explode(F.split(F.replace("text", F.lit(",")), "\n")).alias("line")).where(F.rlike("line", F.lit(r"^(\| (train|val|test|\d+) \||- \d|\d+ patches|- .*K<n|- n>1M)")))


def w26_refreshed(spark, sf_dir) -> DataFrame:
    """The manifest with the splits of a new split, patches beyond the first 2000 rows in none."""
    df = patches(spark, sf_dir).select(c("patch").alias("name"), "row", "col", F.lit("old").alias("split"))
    split = P.random_split(df.select("name", "row"), "name").where("row < 2000")
    return D.refreshed(df, split).select("name", "split")


def t30_geographic(spark, sf_dir) -> DataFrame:
    k = c("c_custkey") % 1200 + 3900
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), affine.is_geographic(k).alias("geographic"))


_OBJ = f"objects AS (SELECT patch, feature, class_id, h0 - ac AS x, v0 - ar AS y, h1 - h0 AS w, v1 - v0 AS h FROM meet WHERE {_SHARE} AND v1 - v0 >= 2 AND h1 - h0 >= 2)"
_YOLO = "regexp_replace(regexp_replace(format('{{:.10f}}', least(greatest({v}, 0e0), 1e0)), '0+$', ''), '\\.$', '')"
_DROP = "CASE WHEN {n} >= 64 THEN ({n} - 64) // {s} + 1 ELSE 0 END"
_SHIFT = "CASE WHEN width >= 64 THEN (width - 64) // 48 + 1 + CASE WHEN (width - 64) % 48 > 0 THEN 1 ELSE 0 END ELSE 1 END"
_MIX = "xor(xor({z}, {z} >> 30) * 13787848793156543929::UHUGEINT % m, (xor({z}, {z} >> 30) * 13787848793156543929::UHUGEINT % m) >> 27)"
_LABEL = "SELECT id AS patch, CASE WHEN r >= 0 AND r < {h} THEN r ELSE -1 END AS r, CASE WHEN c >= 0 AND c < {w} THEN c ELSE -1 END AS c FROM (SELECT id, CAST(floor({row} + 1e-10) AS BIGINT) AS r, CAST(floor({col} + 1e-10) AS BIGINT) AS c FROM (SELECT id, {x} AS x, {y} AS y FROM (SELECT id, \"row\" + 0.5e0 AS v, col + 0.5e0 AS u FROM anchors)))"
_STARS = f"stars AS (SELECT s_suppkey AS id, {_STAR} FROM supplier), edges AS (SELECT id, CASE WHEN x0 <= x1 THEN x0 ELSE x1 END AS x0, CASE WHEN x0 <= x1 THEN y0 ELSE y1 END AS y0, CASE WHEN x0 <= x1 THEN x1 ELSE x0 END AS x1, CASE WHEN x0 <= x1 THEN y1 ELSE y0 END AS y1 FROM ({_EDGES}))"
_TOUCH = """fill AS (SELECT id, r, unnest(range(x, nx)) AS c FROM (SELECT *, row_number() OVER w AS n, lead(x) OVER w AS nx FROM (SELECT id, r, CAST(floor(xt + (r + 0.5e0 - yt) * (xb - xt) / (yb - yt) + 0.5) AS BIGINT) AS x FROM (SELECT *, unnest(range(CAST(ceil(yt - 0.5) AS BIGINT), CAST(ceil(yb - 0.5) AS BIGINT))) AS r FROM (SELECT id, least(y0, y1) AS yt, greatest(y0, y1) AS yb, CASE WHEN y0 <= y1 THEN x0 ELSE x1 END AS xt, CASE WHEN y0 <= y1 THEN x1 ELSE x0 END AS xb FROM edges WHERE y0 <> y1))) WINDOW w AS (PARTITION BY id, r ORDER BY x)) WHERE n % 2 = 1 AND nx > x),
walk AS (SELECT id, CAST(floor(y0) AS BIGINT) AS r, CAST(floor(x0) AS BIGINT) AS c FROM edges
UNION SELECT id, CAST(floor(y0 + (k - x0) * (y1 - y0) / (x1 - x0)) AS BIGINT), k FROM (SELECT *, unnest(range(CAST(floor(x0) + 1 AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS k FROM edges)
UNION SELECT id, CASE WHEN y1 > y0 THEN k ELSE k - 1 END, CAST(floor(x0 + (k - y0) * (x1 - x0) / (y1 - y0)) AS BIGINT) FROM (SELECT *, unnest(range(CAST(floor(least(y0, y1)) + 1 AS BIGINT), CAST(ceil(greatest(y0, y1)) AS BIGINT))) AS k FROM edges))"""

QUERIES = {
    "s3_outcomes": (s3_outcomes, "SELECT id, CASE WHEN p = 'refused' THEN 'failed' WHEN p = 'timeout' THEN CASE WHEN t < 1 THEN 'retry' ELSE 'failed' END WHEN p = 'network' THEN CASE WHEN t < 3 THEN 'retry' ELSE 'failed' END WHEN s IN (200, 204) THEN CASE WHEN good THEN 'ok' ELSE 'failed' END WHEN s IN (429, 500, 503) THEN CASE WHEN t < 3 THEN 'retry' ELSE 'failed' END ELSE 'failed' END AS outcome FROM (SELECT event_id AS id, [200, 204, 404, 429, 500, 503][event_id % 6 + 1] AS s, event_id % 5 <> 0 AS good, event_id % 4 AS t, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN 'network' WHEN event_id % 17 = 0 THEN 'refused' END AS p FROM events)"),
    "s25_range_reads": (s25_range_reads, "SELECT file, min(b) * 16384 AS \"start\", (max(b) + 1) * 16384 AS stop FROM (SELECT file, b, b - row_number() OVER (PARTITION BY file ORDER BY b) AS g FROM (SELECT DISTINCT l_suppkey AS file, unnest(range(l_orderkey * 5000 // 16384, (l_orderkey * 5000 + CAST(l_quantity * 400 AS BIGINT) - 1) // 16384 + 1)) AS b FROM lineitem WHERE l_quantity > 0)) GROUP BY file, g"),
    "s2_tile_windows": (s2_tile_windows, "SELECT x, y, (y - 2000) * 256 AS \"row\", (x - 1001) * 256 AS col, CASE WHEN k % 11 <> 0 THEN 196608 END::BIGINT AS bytes, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 0 ELSE k % 200 + 1 END AS level FROM (SELECT s_suppkey AS k, 1000 + s_suppkey % 10 AS x, 2000 + s_suppkey // 10 AS y FROM supplier) WHERE x BETWEEN 1002 AND 1006 AND y BETWEEN 2000 AND 2390"),
    "s13_missing_tiles": (s13_missing_tiles, "SELECT 1001 + range AS x, 2000::BIGINT AS y FROM range(7) WHERE 1 + range NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 <> 0)"),
    "s19_headers": (s19_headers, "SELECT vec_id AS id, 8::BIGINT AS height, 8::BIGINT AS width, 'float32' AS dtype, CASE WHEN vec_id % 2 = 1 THEN 32600 + vec_id % 60 + 1 ELSE 4326 END AS epsg, CASE WHEN vec_id % 3 <> 0 THEN -9e0 END AS nodata, CAST(vec_id AS DOUBLE) AS x, CAST(2 * vec_id AS DOUBLE) AS y, 0.5e0 AS step FROM embeddings"),
    "s22_blocks": (s22_blocks, "SELECT vec_id AS id, 48::BIGINT AS pixels, round(list_sum(list_transform(embedding[9:56], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings"),
    "s56_fingerprints": (s56_fingerprints, "SELECT page_id, strlen(html) AS size, sha256(unhex(substr(hex(encode(html)), 1, 2000))) AS head_sha256 FROM pages"),
    "s59_patches": (s59_patches, "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 1 THEN 3 ELSE 1 END::BIGINT AS bands, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 100 ELSE 0 END)) AS BIGINT) AS total FROM embeddings"),
    "i2_cut_short": (i2_cut_short, "SELECT vec_id || CASE vec_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.tif' ELSE '.npy' END AS path, CASE WHEN vec_id % 8 <> 0 THEN CASE vec_id % 3 WHEN 0 THEN 'is not a PNG file' WHEN 1 THEN 'is not a TIFF file' ELSE 'is not an NPY file' END ELSE 'is cut short' END AS problem FROM embeddings WHERE vec_id % 4 = 0 AND NOT (vec_id % 3 = 1 AND vec_id % 8 = 0)"),
    "a26_extracted": (a26_extracted, sql("SELECT a.patch, count(*) FILTER (WHERE v >= 0) AS valid, round(coalesce(sum(v) FILTER (WHERE v >= 0), 0), 5) AS total FROM (SELECT p_partkey AS patch, (p_partkey * 7) % 190 AS y, (p_partkey * 11) % 155 AS x FROM part) a JOIN (SELECT id // 20 * 8 + r AS gy, id % 20 * 8 + c AS gx, v FROM pixels) b ON gy >= y AND gy < y + 12 AND gx >= x AND gx < x + 12 GROUP BY a.patch", PIXELS)),
    "w27_world_files": (w27_world_files, sql("SELECT id AS patch, printf('Images/patch_%07d.pgw', id) AS name, '0.5' || chr(10) || '0.0' || chr(10) || '0.0' || chr(10) || '-0.5' || chr(10) || CAST(100 + col * 0.5e0 + 0.25e0 AS VARCHAR) || chr(10) || CAST(900 - \"row\" * 0.5e0 - 0.25e0 AS VARCHAR) || chr(10) AS text FROM anchors", ANCHORS)),
    "s42_kml": (s42_kml, sql("SELECT id, 'Point' AS kind, round(lon, 6) AS x, round(lat, 6) AS y, 'été ' || id AS name FROM points", POINTS)),
    "s44_geopackage": (s44_geopackage, "SELECT s_suppkey AS id, 'Point' AS kind, CAST(s_suppkey AS DOUBLE) AS x, -s_suppkey / 4e0 AS y, 'n' || s_suppkey % 5 AS name FROM supplier"),
    "s47_shapefile": (s47_shapefile, "SELECT s_suppkey AS id, 'MultiPolygon' AS kind, 2::BIGINT AS polygons, 1::BIGINT AS holes, (10 + s_suppkey) * 10 - 4 + 3e0 AS area FROM supplier"),
    "l8_polygonal": (l8_polygonal, "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Polygon' WHEN 3 THEN 'MultiPolygon' ELSE 'GeometryCollection' END AS kind FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 IN (0, 3, 4)"),
    "l9_point_areas": (l9_point_areas, sql("SELECT id, 32::BIGINT AS corners, round(16 * 2500 * sin(2 * pi() / 32), 1) AS area FROM points WHERE abs(lat) < 80", POINTS)),
    "l14_misses": (l14_misses, sql("SELECT class_id, bool_or(r0 < 300 AND c0 < 300) AS overlaps FROM features GROUP BY class_id", FEATURES)),
    "l16_nested": (l16_nested, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS polygons, 1::BIGINT AS holes FROM supplier"),
    "l19_names": (l19_names, "SELECT n_name AS name, CASE WHEN n_name LIKE '% %' THEN 'has a space' WHEN n_name IN ('FRANCE', 'CHINA') THEN 'is taken' END AS problem FROM nation"),
    "s40_relations": (s40_relations, "SELECT s_suppkey AS id, 1::BIGINT AS polygons, 8::BIGINT AS edges, 96e0 AS area FROM supplier"),
    "s51_degrees": (s51_degrees, sql("SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points", POINTS)),
    "s53_attributes": (s53_attributes, "SELECT 'segment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer WHERE c_nationkey > 3 GROUP BY 2"),
    "r9_turned_lookup": (r9_turned_lookup, sql(_LABEL.format(h=700, w=900, row="(y - 400) / -2", col="(x - 90) / 3", x="100 + u * 0.8e0 + v * 0.6e0", y="200 + u * 0.6e0 - v * 0.8e0"), ANCHORS)),
    "r10_other_system": (r10_other_system, sql(_LABEL.format(h=1500, w=2000, row="(y - 48) / -0.01e0", col="(x - 9) / 0.01e0", x="degrees((1e6 + u * 1000) / 6378137)", y="degrees(2 * atan(exp((6e6 - v * 1000) / 6378137)) - pi() / 2)"), ANCHORS)),
    "g4_label_masks": (g4_label_masks, sql("SELECT id, CAST(CASE WHEN value IS NULL OR value IN (8, 9) THEN 255 WHEN value = 0 THEN 10 WHEN value IN (1, 2) THEN 20 WHEN value = 7 THEN 30 ELSE 0 END AS BIGINT) AS class_id, count(*) AS pixels FROM pixels p LEFT JOIN (SELECT p_partkey % 3 AS lr, p_partkey // 3 AS lc, p_size % 10 AS value FROM part WHERE p_partkey // 3 < 3) ON p.r // 2 = lr AND p.c // 2 = lc GROUP BY 1, 2", PIXELS)),
    "v2_touched": (v2_touched, f"WITH {_STARS}, {_TOUCH} SELECT id, count(*) AS pixels FROM (SELECT id, r, c FROM fill UNION SELECT id, r, c FROM walk) GROUP BY id"),
    "v4_edges": (v4_edges, "SELECT s_suppkey AS id, 8::BIGINT AS edges, 4 * (271.5e0 - 16) AS area, 4 * 271.5e0 AS outside, 30::BIGINT AS r0, 60::BIGINT AS r1, CAST(floor((s_suppkey - 13) / 0.5e0) AS BIGINT) AS c0, CAST((s_suppkey + 10) / 0.5e0 AS BIGINT) AS c1 FROM supplier"),
    "v12_valid_parts": (v12_valid_parts, sql(f"SELECT patch, feature, CAST(sum((v1 - v0) * (b - a)) AS BIGINT) AS seen, min(a) AS x0, max(b) AS x1, min(v0) AS y0, max(v1) AS y1 FROM (SELECT *, greatest(h0, ac + s) AS a, least(h1, ac + e) AS b FROM meet, (VALUES (0, 20), (40, 64)) AS t(s, e)) WHERE b > a GROUP BY patch, feature", ANCHORS, FEATURES, MEET)),
    "g16_classification": (g16_classification, sql("SELECT id AS patch, coalesce(single, 0) AS single, coalesce(multi, '0') AS multi FROM anchors LEFT JOIN (SELECT patch, arg_max(class_id, pixels * 1000 - class_id) AS single, string_agg(CAST(class_id AS VARCHAR), ' ' ORDER BY class_id) AS multi FROM (SELECT *, pixels / sum(pixels) OVER (PARTITION BY patch) AS s FROM counts) WHERE class_id <> 0 AND s >= 0.02e0 GROUP BY patch) ON id = patch", ANCHORS, FEATURES, BURNED, IN_PATCH, COUNTS)),
    "a2_positions": (a2_positions, sql(f"SELECT id, 'drop' AS strategy, unnest(range({_DROP.format(n='width', s=48)})) * 48 AS col FROM rasters UNION ALL SELECT id, 'pad', unnest(range((width - 1) // 48 + 1)) * 48 FROM rasters UNION ALL SELECT id, 'shift', greatest(0, least(j * 48, width - 64)) FROM (SELECT id, width, unnest(range({_SHIFT})) AS j FROM rasters)", RASTERS)),
    "a11_defaults": (a11_defaults, sql(f"SELECT id, i * 64 AS \"row\", j * 64 AS col, false AS padded FROM (SELECT *, unnest(range({_DROP.format(n='width', s=64)})) AS j FROM (SELECT *, unnest(range({_DROP.format(n='height', s=64)})) AS i FROM rasters))", RASTERS)),
    "a13_short_draws": (a13_short_draws, sql("SELECT id, n, 'only ' || n || ' of 5000 random patches have a place' AS warning FROM (SELECT id, CASE WHEN height >= 64 AND width >= 64 THEN (height - 63) * (width - 63) ELSE 0 END AS n FROM rasters) WHERE n < 5000", RASTERS)),
    "a18_windows": (a18_windows, sql("SELECT id, \"row\" // 512 AS chunk, (col - min(col) OVER (PARTITION BY \"row\" // 512)) // 836 AS \"window\" FROM anchors", ANCHORS)),
    "a8_generator": (a8_generator, f"WITH s AS (SELECT c_custkey AS id, 18446744073709551616::UHUGEINT AS m, (c_custkey::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS a, (c_custkey::UHUGEINT + 2::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS b FROM customer), t AS (SELECT id, m, {_MIX.format(z='a')} AS a, {_MIX.format(z='b')} AS b FROM s), u AS (SELECT id, m, a * 10723151780598845931::UHUGEINT % m AS a, b * 10723151780598845931::UHUGEINT % m AS b FROM t), v AS (SELECT id, xor(a, a >> 31) AS a, xor(b, b >> 31) AS b FROM u) SELECT id, CAST(a AS VARCHAR) AS \"first\", CAST(b AS VARCHAR) AS \"second\", CAST((b * 1000::UHUGEINT) >> 64 AS BIGINT) AS below FROM v"),
    "m8_sizes": (m8_sizes, "SELECT s_suppkey AS id, CASE WHEN n < 1000 THEN 'n<1K' WHEN n < 10000 THEN '1K<n<10K' WHEN n < 100000 THEN '10K<n<100K' WHEN n < 1000000 THEN '100K<n<1M' ELSE 'n>1M' END AS category, CASE WHEN b < 1e3 THEN CAST(CAST(b AS BIGINT) AS VARCHAR) || ' B' WHEN b < 1e6 THEN format('{:.1f} KB', b / 1e3) WHEN b < 1e9 THEN format('{:.1f} MB', b / 1e6) WHEN b < 1e12 THEN format('{:.1f} GB', b / 1e9) ELSE format('{:.1f} TB', b / 1e12) END AS size FROM (SELECT s_suppkey, s_suppkey ** 3 AS n, s_suppkey ** 3 * 1e3 AS b FROM supplier)"),
    "m15_large_jobs": (m15_large_jobs, "SELECT id, t > 20000 OR b > 5368709120 OR n > 1000000 AS large, nullif(concat_ws(', ', CASE WHEN t > 20000 THEN t || ' tiles' END, CASE WHEN b > 5368709120 THEN CASE WHEN b < 1e12 THEN format('{:.1f} GB', b / 1e9) ELSE format('{:.1f} TB', b / 1e12) END END, CASE WHEN n > 1000000 THEN n || ' patches' END), '') AS reason, round((id % 500 + 1) ** 2 * 6.4e0, 3) AS image FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 37 ELSE 0 END AS t, c_custkey * 17000000 AS b, c_custkey * 1700 AS n FROM customer)"),
    "i7_resumed": (i7_resumed, sql("SELECT \"row\", col FROM anchors WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)", ANCHORS)),
    "p17_resplit": (p17_resplit, sql("SELECT id AS patch, split FROM split", ANCHORS, _SPLIT_OF.format(by="PARTITION BY p_brand", rows="anchors"))),
    "p18_geometry": (p18_geometry, "SELECT 64::BIGINT AS patch_size, 48::BIGINT AS stride"),
    "w2_source_names": (w2_source_names, sql("SELECT id AS patch, s AS source, printf('Images' || f || '/patch_%07d.tif', id) AS name FROM anchors, (VALUES ('rgb', ''), ('sar', '_sar')) AS t(s, f)", ANCHORS)),
    "w14_change_names": (w14_change_names, sql("SELECT id AS patch, printf('A/patch_%07d.png', id) AS before, printf('B/patch_%07d.png', id) AS after, printf('label/patch_%07d.png', id) AS label FROM anchors", ANCHORS)),
    "w7_detection_files": (w7_detection_files, sql("SELECT printf('labels/patch_%07d.txt', id) AS name, coalesce(t, '') AS content FROM anchors LEFT JOIN (SELECT patch, string_agg(CAST(class_id - 1 AS VARCHAR) || ' ' || " + " || ' ' || ".join(_YOLO.format(v=v) for v in ("(x + w / 2) / 64", "(y + h / 2) / 64", "w / 64", "h / 64")) + ", chr(10) ORDER BY feature) AS t FROM objects GROUP BY patch) ON patch = id", ANCHORS, FEATURES, MEET, _OBJ)),
    "w11_dataset_yaml": (w11_dataset_yaml, sql("SELECT 'train: train.txt' || chr(10) || 'val: val.txt' || chr(10) || 'test: test.txt' || chr(10) || 'names:' || chr(10) || string_agg('  ' || i || ': \"' || class_name || '\"' || chr(10), '' ORDER BY i) AS text FROM (SELECT class_name, row_number() OVER (ORDER BY class_id) - 1 AS i FROM (SELECT DISTINCT class_id, class_name FROM features))", FEATURES)),
    "w24_card": (w24_card, sql("SELECT count(*) || ' patches.' AS line FROM anchors UNION ALL SELECT '| ' || split || ' | ' || count(*) || ' |' FROM split GROUP BY split UNION ALL SELECT '| ' || i || ' | ' || n || ' |' FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(SEGMENTS, 1)) + ", (255, 'no imagery or no label')) AS v(i, n) UNION ALL SELECT '- ' || CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END FROM anchors HAVING count(*) >= 1000", ANCHORS, _SPLIT_OF.format(by="", rows="anchors"))),
    "w26_refreshed": (w26_refreshed, sql("SELECT id AS name, CASE WHEN \"row\" < 2000 THEN split ELSE '' END AS split FROM split JOIN anchors USING (id)", ANCHORS, _SPLIT_OF.format(by="", rows="anchors"))),
    "t30_geographic": (t30_geographic, "SELECT c_custkey AS id, c_custkey % 1200 + 3900 BETWEEN 4000 AND 4999 AS geographic FROM customer"),
}

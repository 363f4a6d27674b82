"""File sources against files made here, byte by byte where the format is one we only read."""

import json
import math
import sqlite3
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.sources import png, raster, tiff, vector, wkb
from geoloom.streaming import jobs

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
GEOMETRIES = [("Point", [[[(1.5, -2.0)]]]), ("LineString", [[SQUARE]]), ("Polygon", [[SQUARE, HOLE]]), ("MultiPolygon", [[SQUARE], [HOLE]]), ("MultiPoint", [[[(1.0, 2.0)]], [[(3.0, 4.0)]]]), ("MultiLineString", [[SQUARE], [HOLE]])]


@pytest.mark.parametrize("kind,parts", GEOMETRIES)
def test_wkb_round_trip(kind, parts):
    assert wkb.parse(wkb.build(kind, parts)) == (kind, parts)
    with pytest.raises(wkb.Broken):
        wkb.parse(wkb.build(kind, parts)[:-1])


def test_wkb_of_other_dialects():
    assert wkb.parse(struct.pack(">BI3d", 0, 1001, 1, 2, 3)) == ("Point", [[[(1.0, 2.0)]]])
    assert wkb.parse(struct.pack("<BIIddd", 1, 0xA0000001, 4326, 1, 2, 3)) == ("Point", [[[(1.0, 2.0)]]])
    assert wkb.parse(struct.pack("<BIdd", 1, 1, math.nan, math.nan)) == ("Point", [])
    with pytest.raises(wkb.Broken):
        wkb.parse((struct.pack("<BII", 1, 7, 1)) * 30)


def rows_of(df):
    return [(r.kind, None if r.parts is None else [[[(p.x, p.y) for p in ring] for ring in part] for part in r.parts], dict(r.properties)) for r in df.orderBy("file", "seq").collect()]


def test_geojson(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"class": "forêt", "n": 5.0, "b": True}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}}, {"type": "Feature", "properties": None, "geometry": None}, {"type": "Feature", "properties": {"x": [1]}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2, 3]}]}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}), encoding="utf-8-sig")
    got = rows_of(vector.load(spark, f"{tmp_path}/a.geojson"))
    assert got == [("Polygon", [[SQUARE, HOLE]], {"class": "forêt", "n": "5.0", "b": "true"}), (None, None, {}), ("GeometryCollection", [[[(1.0, 2.0)]]], {"x": "[1]"})]


def test_kml(spark, tmp_path):
    ring = " ".join(f"{x},{y},0" for x, y in SQUARE)
    text = f"""<?xml version="1.0" encoding="ISO-8859-1"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><Placemark><name>é</name><ExtendedData><SchemaData><SimpleData name="class">wood</SimpleData></SchemaData><Data name="k"><value>v</value></Data></ExtendedData>
<MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs></Polygon><Point><coordinates>1,2</coordinates></Point></MultiGeometry></Placemark><Placemark/></Folder></Document></kml>"""
    (tmp_path / "a.kml").write_bytes(text.encode("latin-1"))
    got = rows_of(vector.load(spark, f"{tmp_path}/a.kml"))
    assert got == [("GeometryCollection", [[SQUARE], [[(1.0, 2.0)]]], {"name": "é", "class": "wood", "k": "v"}), (None, None, {})]
    with pytest.raises(ValueError, match="document type"):
        list(vector.parse_kml(b"<!DOCTYPE kml><kml/>"))


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.executescript("CREATE TABLE gpkg_contents (table_name, data_type); CREATE TABLE gpkg_geometry_columns (table_name, column_name); CREATE TABLE \"a b\" (fid INTEGER PRIMARY KEY, geom BLOB, class TEXT, n REAL); CREATE TABLE other (fid INTEGER PRIMARY KEY, geom BLOB)")
    db.executemany("INSERT INTO gpkg_contents VALUES (?, 'features')", [("a b",), ("other",)])
    db.executemany("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", [("a b",), ("other",)])
    blob = b"GP\0\x03" + struct.pack("<i4d", 4326, 0, 4, 0, 4) + wkb.build("Polygon", [[SQUARE]])
    db.executemany("INSERT INTO \"a b\" VALUES (?, ?, ?, ?)", [(1, blob, "x", 2.5), (2, None, None, None), (3, b"GP\0\x11" + struct.pack("<i", 0), "y", 1)])
    db.commit()
    db.close()
    got = rows_of(vector.geopackage(spark, f"{tmp_path}/a.gpkg", "a b"))
    assert got == [("Polygon", [[SQUARE]], {"class": "x", "n": "2.5"}), (None, None, {"class": None, "n": None}), (None, None, {"class": "y", "n": "1.0"})]
    with pytest.raises(Exception, match="layers"):
        vector.load(spark, f"{tmp_path}/a.gpkg").collect()


def shape_file(records):
    body = b""
    for i, content in enumerate(records):
        body += struct.pack(">2i", i + 1, len(content) // 2) + content
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def polygon_record(rings):
    places = [p for r in rings for p in r]
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    return struct.pack("<i4d2i", 5, 0, 0, 4, 4, len(rings), len(places)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in places)


def test_shapefile(spark, tmp_path):
    far = [(x + 10, y) for x, y in SQUARE]
    (tmp_path / "a.shp").write_bytes(shape_file([polygon_record([HOLE, SQUARE, far]), struct.pack("<i", 0), struct.pack("<i2d", 1, 7, 8)]))
    fields = [(b"CLASS", b"C", 6, 0), (b"N", b"N", 5, 0), (b"F", b"N", 6, 2)]
    head = b"\x03\0\0\0" + struct.pack("<IHH", 3, 32 + 32 * 3 + 1, 18) + bytes(20)
    head += b"".join(n.ljust(11, b"\0") + k + bytes(4) + bytes([w, d]) + bytes(14) for n, k, w, d in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + " for\xeat  12  1.50".encode("latin-1")[:18].ljust(18) + b" b       *  3.00  "[:18].ljust(18) + b" c        7       ")
    (tmp_path / "a.cpg").write_text("ISO-8859-1")
    got = rows_of(vector.load(spark, f"{tmp_path}/a.shp"))
    assert [k for k, _, _ in got] == ["MultiPolygon", None, "Point"]
    assert sorted(map(str, got[0][1])) == sorted(map(str, [[SQUARE, HOLE], [far]])) and got[0][2]["CLASS"] == "forêt"
    assert got[2][1] == [[[(7.0, 8.0)]]]


def test_nested_rings_alternate():
    ring = lambda k: [(k, k), (20 - k, k), (20 - k, 20 - k), (k, 20 - k), (k, k)]
    found = vector.nested([ring(3), ring(0), ring(2), ring(1), [(0, 0), (1, 1)]])
    assert found == [[ring(0), ring(1)], [ring(2), ring(3)]]


def test_geoparquet(spark, tmp_path):
    spark.createDataFrame([(i, bytearray(wkb.build(k, p)), "x") for i, (k, p) in enumerate(GEOMETRIES)] + [(99, None, "y")], "id int, geometry binary, name string").write.parquet(f"{tmp_path}/a.parquet")
    got = {r.id: r for r in vector.geoparquet(spark, f"{tmp_path}/a.parquet", columns=["id"]).collect()}
    assert [got[i].kind for i in range(len(GEOMETRIES))] == [k for k, _ in GEOMETRIES] and got[99].parts is None
    assert set(got[0].asDict()) == {"id", "kind", "parts"}


def lzw_encoded(data):
    table, width, bits, previous = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
    for byte in data:
        more = previous + bytes([byte])
        if more in table:
            previous = more
            continue
        bits.append((table[previous], width))
        table[more] = len(table) + 2
        if len(table) + 2 == 4095:
            bits.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        else:
            width = 9 + (len(table) + 2 >= 512) + (len(table) + 2 >= 1024) + (len(table) + 2 >= 2048)
        previous = bytes([byte])
    bits += [(table[previous], width)] if previous else []
    text = "".join(format(c, f"0{w}b") for c, w in bits)
    text += format(257, f"0{width}b")
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


@given(st.binary(max_size=600), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_packbits_and_lzw(data, times):
    data = data * times
    packed = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))
    assert tiff.unpack_bits(packed) == data
    assert tiff.unpack_bits(b"\xfe\x07\x80\x00\x05") == b"\x07\x07\x07\x05"
    if data:
        assert tiff.lzw(lzw_encoded(data))[: len(data)] == data


@pytest.mark.parametrize("dtype", ["u1", "i2", "u2", "u4", "i4", "f4", "f8", "u8"])
@pytest.mark.parametrize("bands", [1, 3])
def test_tiff_round_trip(dtype, bands):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 200, (150, 70, bands)).astype(dtype)
    t = (2.0, 0.0, 100.0, 0.0, -2.0, 900.0)
    data = tiff.write(image, t, 32633, nodata=7)
    info = tiff.read_info(data)
    assert (info.height, info.width, info.bands, info.epsg, info.nodata, info.transform) == (150, 70, bands, 32633, 7.0, t)
    got, valid = tiff.read_window(data, info, 0, 150, 0, 70)
    assert (got == image).all() and valid.all()
    part, inside = tiff.read_window(data, info, 140, 160, -5, 10)
    assert (part[:10, 5:] == image[140:, :10]).all() and inside.sum() == 100 and (part[~inside] == 7).all()


def test_tiff_predictors_and_order():
    image = np.arange(600, dtype=">u2").reshape(20, 30, 1)
    info = tiff.Info(30, 20, 1, np.dtype(">u2"), None, None, None, {317: (2,), 259: (1,)}, ">")
    diff = np.diff(image, axis=1, prepend=np.zeros((20, 1, 1), ">u2")).astype(">u2")
    assert (tiff.decode_block(info, diff.tobytes(), 20, 30, 1) == image).all()
    values = np.random.default_rng(2).normal(size=(4, 6, 1)).astype(np.float32)
    planes = values.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    packed = np.diff(planes, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8)
    info = tiff.Info(6, 4, 1, np.dtype("<f4"), None, None, None, {317: (3,), 259: (1,)})
    assert (tiff.decode_block(info, packed.tobytes(), 4, 6, 1) == values).all()


@pytest.mark.parametrize("bands", [1, 3, 4])
def test_png_round_trip(bands):
    image = np.random.default_rng(3).integers(0, 255, (20, 30, bands), np.uint8)
    got = png.decode(png.encode(image))
    want = np.repeat(image, 3, 2) if bands == 1 else image[:, :, :3].copy()
    if bands == 4:
        want[image[:, :, 3] == 0] = 0
    assert (got == want).all()


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    row, above, n = rng.integers(0, 256, 30), rng.integers(0, 256, 30), 3
    coded = []
    for i, v in enumerate(row):
        a, b, c = row[i - n] if i >= n else 0, above[i], above[i - n] if i >= n else 0
        nearest = min((a, b, c), key=lambda x: abs(int(a) + int(b) - int(c) - int(x)))
        coded.append((int(v) - [0, a, b, (int(a) + int(b)) // 2, nearest][kind]) % 256)
    assert (png.unfiltered(kind, np.array(coded, np.uint8), above.astype(np.uint8), n) == row).all()


def test_rasters_as_tables(spark, tmp_path):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 9, (90, 70, 2)).astype("u2") for _ in range(2)]
    for i, image in enumerate(images):
        (tmp_path / f"f{i}.tif").write_bytes(tiff.write(image, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 3857, nodata=0))
    head = raster.geotiff_headers(raster.files(spark, f"{tmp_path}/*.tif")).orderBy("file").first()
    assert (head.height, head.width, head.bands, head.dtype, head.epsg, head.nodata) == (90, 70, 2, "uint16", 3857, 0.0)
    table = raster.pixels(raster.geotiff_blocks(raster.files(spark, f"{tmp_path}/*.tif"), side=32))
    assert table.count() == 2 * 90 * 70
    files = [r.file for r in table.select("file").distinct().orderBy("file").collect()]
    offsets = spark.createDataFrame([(files[0], 0, 0), (files[1], 10, 5)], "file string, row_offset long, col_offset long")
    got = {(r.r, r.c): r["values"] for r in raster.mosaic(table, offsets).collect()}
    for (r, k), values in got.items():
        a = images[0][r, k] if r < 90 and k < 70 else np.zeros(2)
        b = images[1][r - 10, k - 5] if 0 <= r - 10 < 90 and 0 <= k - 5 < 70 else np.zeros(2)
        assert values == list(a if a.any() else b)
    cut = raster.geotiff_blocks(raster.files(spark, f"{tmp_path}/f0.tif"), window=(5, 15, 60, 99)).collect()
    assert [(b.row, b.col, b.height, b.width) for b in cut] == [(5, 60, 10, 10)]


def test_patches_as_files(spark, tmp_path):
    image = np.random.default_rng(5).integers(0, 255, (256, 256, 3), np.uint8)
    df = spark.createDataFrame([("p", 256, 256, 3, "uint8", bytearray(image.tobytes()))], "name string, height int, width int, bands int, dtype string, pixels binary")
    for kind in ("png", "npy", "tif"):
        files = raster.encoded(df, kind).withColumn("name", F.concat(F.lit("Images/"), F.col("name"), F.lit(f".{kind}")))
        assert raster.save_files(files, f"file://{tmp_path}/out").first().name == f"Images/p.{kind}"
    assert (np.load(tmp_path / "out/Images/p.npy") == np.moveaxis(image, -1, 0)).all()
    assert raster.cut_short(raster.files(spark, f"file://{tmp_path}/out/Images")).count() == 0
    whole = (tmp_path / "out/Images/p.png").read_bytes()
    (tmp_path / "out/Images/q.png").write_bytes(whole[:-5])
    (tmp_path / "out/Images/r.tif").write_bytes(b"II")
    assert {r.path[-5:]: r.problem for r in raster.cut_short(raster.files(spark, f"file://{tmp_path}/out/Images")).collect()} == {"q.png": "is cut short", "r.tif": "is not a TIFF file"}
    tiles = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(b"<html>")), (3, None)], "id int, content binary")
    got = {r.id: r.rgb for r in raster.decoded_tiles(tiles).collect()}
    assert got[1] == image.tobytes() and got[2] is None and got[3] is None


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", f"s{m % 2}", m % 5 != 0) for m in range(60)] + [("2024-01-01 05:00:00", "s0", True)]
    spark.createDataFrame(rows, "ts string, source string, ok boolean").select(F.col("ts").cast("timestamp").alias("ts"), "source", "ok").coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("ts timestamp, source string, ok boolean").parquet(f"{tmp_path}/log")
    query = jobs.fetch_failures(stream, "30 minutes").writeStream.outputMode("append").format("memory").queryName("failures").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.start.minute, r.source): (r.failed, r.total, r.stop) for r in spark.table("failures").collect()}
    assert got == {(m, s): (3, 15, True) for m in (0, 30) for s in ("s0", "s1")}
    batch = spark.read.parquet(f"{tmp_path}/log")
    once = jobs.unique_anchors(stream, ["source"]).writeStream.outputMode("append").format("memory").queryName("once").start()
    once.processAllAvailable()
    once.stop()
    assert spark.table("once").count() == 2
    jobs.append_once(batch, 1, f"{tmp_path}/sink")
    jobs.append_once(batch, 1, f"{tmp_path}/sink")
    assert spark.read.parquet(f"{tmp_path}/sink").count() == len(rows)
    stack = jobs.stacks(batch.select("ts", F.col("source").alias("patch"), F.col("ok").alias("image"))).collect()
    assert sum(len(r.images) for r in stack) == len(rows)

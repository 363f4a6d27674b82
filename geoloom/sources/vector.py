"""Vector files as feature tables: GeoJSON, KML, GeoPackage, Shapefile, GeoParquet.

Each reader takes a path or glob that Spark can read and gives FEATURES: the file, the place of the
feature in it, the geometry's kind and parts (polygons of rings of x, y), and its attributes as a map
of texts. Files are read whole by one task each, since none of these formats but GeoParquet splits.
"""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources import wkb

RING = "array<struct<x:double,y:double>>"
FEATURES = f"file string, seq long, kind string, parts array<array<{RING}>>, properties map<string,string>"
_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(_RING)), pa.map_(pa.string(), pa.string())]
_NAMES = ["file", "seq", "kind", "parts", "properties"]
BATCH = 4096

Feature = tuple[str | None, list | None, dict]


def text_of(value: object) -> str | None:
    """An attribute as text: JSON's true and null, numbers as written, other values as JSON."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def read_with(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[Feature]]) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for seq, (kind, parts, properties) in enumerate(parse(content.as_py())):
                    rings = None if parts is None else [[[{"x": float(x), "y": float(y)} for x, y, *_ in ring] for ring in rings] for rings in parts]
                    rows.append((file, seq, kind, rings, [(k, text_of(v)) for k, v in properties.items()]))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FEATURES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def geometry_parts(geometry: dict | None) -> tuple[str | None, list | None]:
    """Kind and parts of a GeoJSON geometry."""
    if not geometry:
        return None, None
    kind, places = geometry.get("type"), geometry.get("coordinates")
    if kind == "GeometryCollection":
        return kind, [p for g in geometry.get("geometries") or [] for p in geometry_parts(g)[1] or []]
    deep = {"Point": lambda c: [[[c]]], "MultiPoint": lambda c: [[[p]] for p in c], "LineString": lambda c: [[c]], "MultiLineString": lambda c: [[r] for r in c], "Polygon": lambda c: [c], "MultiPolygon": lambda c: c}
    if kind not in deep or places is None:
        raise ValueError(f"no GeoJSON geometry: {kind}")
    return kind, deep[kind](places) if places else []


def parse_geojson(data: bytes) -> Iterator[Feature]:
    document = json.loads(data.decode("utf-8-sig"))
    kind = document.get("type") if isinstance(document, dict) else None
    if kind not in ("FeatureCollection", "Feature"):
        raise ValueError("the file holds no GeoJSON features")
    for feature in document.get("features") or [] if kind == "FeatureCollection" else [document]:
        yield *geometry_parts(feature.get("geometry")), feature.get("properties") or {}


def geojson(spark: SparkSession, path: str) -> DataFrame:
    return read_with(spark, path, parse_geojson)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _kml_ring(text: str | None) -> list:
    return [tuple(float(v) for v in place.split(",")[:2]) for place in (text or "").split()]


def _kml_parts(node: ElementTree.Element) -> list[tuple[str, list]]:
    name = _local(node.tag)
    find = lambda parent, *names: [x for x in parent.iter() if _local(x.tag) in names]
    if name == "MultiGeometry":
        return [p for child in node for p in _kml_parts(child)]
    if name == "Polygon":
        sides = [side for side in node if _local(side.tag) in ("outerBoundaryIs", "innerBoundaryIs")]
        sides.sort(key=lambda s: _local(s.tag) != "outerBoundaryIs")
        return [("Polygon", [_kml_ring(x.text) for side in sides for x in find(side, "coordinates")])]
    if name in ("LineString", "LinearRing", "Point"):
        return [("Point" if name == "Point" else "LineString", [_kml_ring(x.text) for x in find(node, "coordinates")])]
    return []


def parse_kml(data: bytes) -> Iterator[Feature]:
    """Placemarks with their name, description and extended data. Document types are refused: entities could grow without bound."""
    head = data[:4096].lstrip(b"\xef\xbb\xbf")
    if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
        raise ValueError("KML with a document type is not read")
    for mark in ElementTree.fromstring(data).iter():
        if _local(mark.tag) != "Placemark":
            continue
        properties: dict[str, str | None] = {}
        found: list[tuple[str, list]] = []
        for child in mark:
            name = _local(child.tag)
            if name in ("name", "description"):
                properties[name] = (child.text or "").strip()
            elif name == "ExtendedData":
                for x in child.iter():
                    if _local(x.tag) == "SimpleData":
                        properties[x.get("name", "")] = (x.text or "").strip()
                    elif _local(x.tag) == "Data":
                        properties[x.get("name", "")] = next(((v.text or "").strip() for v in x if _local(v.tag) == "value"), "")
            else:
                found += _kml_parts(child)
        kinds = {k for k, _ in found}
        kind = None if not found else found[0][0] if len(found) == 1 else f"Multi{kinds.pop()}" if len(kinds) == 1 else "GeometryCollection"
        yield kind, [p for _, p in found] if found else None, properties


def kml(spark: SparkSession, path: str) -> DataFrame:
    return read_with(spark, path, parse_kml)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def geopackage_layers(data: bytes) -> list[str]:
    with sqlite3.connect(":memory:") as db:
        db.deserialize(data)
        return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]


def parse_geopackage(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    layers = geopackage_layers(data)
    if layer is None and len(layers) != 1:
        raise ValueError(f"name one of the layers {layers}")
    layer = layer or layers[0]
    if layer not in layers:
        raise ValueError(f"no layer {layer!r}; there are {layers}")
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    column = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()[0]
    rows = db.execute(f"SELECT * FROM {_quoted(layer)} ORDER BY rowid")
    names = [d[0] for d in rows.description]
    keys = {r[1] for r in db.execute(f"PRAGMA table_info({_quoted(layer)})") if r[5]}
    for row in rows:
        values = dict(zip(names, row, strict=True))
        blob = wkb.from_geopackage(values.pop(column))
        kind, parts = wkb.parse(blob) if blob else (None, None)
        yield kind, parts, {k: v for k, v in values.items() if k not in keys and not isinstance(v, bytes)}
    db.close()


def geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    return read_with(spark, path, lambda data: parse_geopackage(data, layer))


def signed_area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def inside(point: tuple, ring: list) -> bool:
    x, y = point
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


def nested(rings: list[list]) -> list[list]:
    """Polygons of rings in any order and direction: one inside an even number of others is a shell, the others are holes
    of the smallest ring around them."""
    order = sorted((r for r in rings if len(r) > 3 and signed_area(r)), key=lambda r: abs(signed_area(r)))
    around = [[j for j in range(i + 1, len(order)) if inside(order[i][0], order[j])] for i in range(len(order))]
    polygons = {i: [order[i]] for i in range(len(order)) if len(around[i]) % 2 == 0}
    for i, outer in enumerate(around):
        if len(outer) % 2:
            polygons[outer[0]].append(order[i])
    return [polygons[i] for i in sorted(polygons, reverse=True)]


def parse_shapes(data: bytes) -> Iterator[tuple[str | None, list | None]]:
    """Geometries of a .shp file."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("no shapefile")
    at = 100
    while at + 12 <= len(data):
        length = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = data[at + 8 : at + 8 + length]
        at += 8 + length
        code = struct.unpack_from("<i", body)[0]
        if code == 0:
            yield None, None
        elif code in (1, 11, 21):
            yield "Point", [[[struct.unpack_from("<2d", body, 4)]]]
        elif code in (8, 18, 28):
            n = struct.unpack_from("<i", body, 36)[0]
            yield "MultiPoint", [[[struct.unpack_from("<2d", body, 40 + 16 * i)]] for i in range(n)]
        elif code in (3, 5, 13, 15, 23, 25):
            n_parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
            first = 44 + 4 * n_parts
            places = [struct.unpack_from("<2d", body, first + 16 * i) for i in range(n)]
            rings = [places[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            if code % 10 == 3:
                yield ("LineString" if len(rings) == 1 else "MultiLineString"), [[r] for r in rings]
            else:
                polygons = nested(rings)
                yield ("Polygon" if len(polygons) == 1 else "MultiPolygon"), polygons
        else:
            raise ValueError(f"shape type {code}")


def parse_dbf(data: bytes, encoding: str = "utf-8") -> Iterator[dict]:
    """Attribute rows of a .dbf file; deleted ones are null."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode(encoding, "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    for i in range(n):
        row, values = data[head + i * size : head + (i + 1) * size], {}
        place = 1
        for name, kind, width, decimals in fields:
            text = row[place : place + width].decode(encoding, "replace").strip(" \0")
            place += width
            if kind in "NF":
                values[name] = None if not text or "*" in text else float(text) if decimals or "." in text else int(text)
            elif kind == "L":
                values[name] = {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
            else:
                values[name] = text or None
        yield values


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """path: the .shp file, with a .dbf beside it (and a .cpg that names its encoding)."""
    stem = path[: -len(".shp")]
    read = lambda suffix: spark.read.format("binaryFile").load(stem + suffix).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), F.col("content").alias(suffix[1:]))
    both = read(".shp").join(read(".dbf"), "stem")
    try:
        both = both.join(read(".cpg"), "stem", "left")
    except Exception:  # noqa: BLE001 - the file is optional, and its absence shows on reading
        both = both.withColumn("cpg", F.lit(None).cast("binary"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                encoding = (row["cpg"] or b"utf-8").decode("ascii", "replace").strip().lower() or "utf-8"
                rows = []
                for seq, ((kind, parts), values) in enumerate(zip(parse_shapes(row["shp"]), parse_dbf(row["dbf"], encoding), strict=False)):
                    rings = None if parts is None else [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in parts]
                    rows.append((row["stem"] + ".shp", seq, kind, rings, [(k, text_of(v)) for k, v in values.items()]))
                if rows:
                    yield _batch(rows)

    return both.select("stem", "shp", "dbf", "cpg").mapInArrow(run, FEATURES)


def wkb_parts(df: DataFrame, column: str) -> DataFrame:
    """df with kind and parts of a WKB column; null where it is null."""
    at = df.columns.index(column)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"kind string, parts array<array<{RING}>>"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            parsed = [wkb.parse(x) if x else (None, None) for x in batch.column(at).to_pylist()]
            shaped = [None if p is None else [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in p] for _, p in parsed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k for k, _ in parsed], pa.string()), pa.array(shaped, _TYPES[3])], [*batch.schema.names, "kind", "parts"])

    return df.mapInArrow(run, schema)


def geoparquet(spark: SparkSession, path: str, geometry: str = "geometry", columns: list[str] | None = None) -> DataFrame:
    """Splits and prunes columns as any Parquet; geometries are decoded in Arrow batches."""
    df = spark.read.parquet(path)
    names = [c for c in df.columns if c != geometry and (columns is None or c in columns)]
    return wkb_parts(df.select(geometry, *names), geometry).drop(geometry)


READERS = {".geojson": geojson, ".json": geojson, ".kml": kml, ".gpkg": geopackage, ".shp": shapefile, ".parquet": geoparquet}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Any of the formats by the name's ending."""
    for ending, reader in READERS.items():
        if path.lower().endswith(ending):
            return reader(spark, path, **options)
    raise ValueError(f"no reader for {path}; the endings are {', '.join(READERS)}")

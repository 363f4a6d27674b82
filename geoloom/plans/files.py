"""Queries of the file formats, on bytes made from the tables and read back, and of the streaming jobs run as batches."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.plans.tables import POINTS, points, sql, table
from geoloom.sources import png, tiff, vector, wkb
from geoloom.streaming import jobs

c = F.col


def located(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).select("id", "lon", "lat")


def with_bytes(df: DataFrame, build) -> DataFrame:
    """id and the bytes that build makes of each row's other columns."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([build(r) for r in rows], pa.binary())], ["id", "data"])

    return df.mapInArrow(run, "id long, data binary")


def s50_wkb(spark, sf_dir) -> DataFrame:
    """Squares around points to WKB and back: the corners' mean and number."""
    square = lambda r: [(r["lon"] + dx, r["lat"] + dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    data = with_bytes(located(spark, sf_dir), lambda r: wkb.build("Polygon", [[square(r)]]))
    ring = c("parts")[0][0]
    mean = lambda f: F.round(F.aggregate(F.slice(ring, 1, 4), F.lit(0.0), lambda s, p: s + p[f]) / 4, 6)
    return vector.wkb_parts(data, "data").select("id", "kind", F.size(ring).cast("bigint").alias("corners"), mean("x").alias("x"), mean("y").alias("y"))


def s46_geopackage_blobs(spark, sf_dir) -> DataFrame:
    """Points in GeoPackage blobs with and without an envelope."""

    def build(r: dict) -> bytes:
        body = wkb.build("Point", [[[(r["lon"], r["lat"])]]])
        if r["id"] % 2:
            return b"GP\0\x03" + struct.pack("<i4d", 4326, r["lon"], r["lon"], r["lat"], r["lat"]) + body
        return b"GP\0\x01" + struct.pack("<i", 4326) + body

    data = with_bytes(located(spark, sf_dir), build)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            places = [wkb.parse(wkb.from_geopackage(x))[1][0][0][0] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in places]), pa.array([p[1] for p in places])], ["id", "x", "y"])

    return data.mapInArrow(run, "id long, x double, y double").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def s41_geojson(spark, sf_dir) -> DataFrame:
    """Points as GeoJSON features and back."""
    build = lambda r: json.dumps({"type": "Feature", "properties": {"n": r["id"]}, "geometry": {"type": "Point", "coordinates": [r["lon"], r["lat"]]}}).encode()
    data = with_bytes(located(spark, sf_dir), build)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [next(vector.parse_geojson(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[2]["n"] for r in rows], pa.int64()), pa.array([float(r[1][0][0][0][0]) for r in rows]), pa.array([float(r[1][0][0][0][1]) for r in rows])], ["id", "x", "y"])

    return data.mapInArrow(run, "id long, x double, y double").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def patches(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), "embedding")


def sums(data: DataFrame, read) -> DataFrame:
    """id, pixels and the sum of what read gives for each row's bytes."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            images = [read(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.size for x in images], pa.int64()), pa.array([float(x.astype(np.float64).sum()) for x in images])], ["id", "pixels", "total"])

    return data.mapInArrow(run, "id long, pixels long, total double").select("id", "pixels", F.round("total", 5).alias("total"))


def s20_geotiff_windows(spark, sf_dir) -> DataFrame:
    """Patches as GeoTIFFs of strips, the two middle rows read back."""
    data = with_bytes(patches(spark, sf_dir), lambda r: tiff.write(np.array(r["embedding"], np.float32).reshape(8, 8), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 3857, rows_per_strip=2))
    return sums(data, lambda x: tiff.read_window(x, tiff.read_info(x), 3, 5, 0, 8)[0])


def s10_decoded_png(spark, sf_dir) -> DataFrame:
    """Patches as gray PNG and back to RGB."""
    level = lambda r: (np.array(r["embedding"], np.float64) > 0).astype(np.uint8).reshape(8, 8) * 200
    return sums(with_bytes(patches(spark, sf_dir), lambda r: png.encode(level(r))), png.decode)


def w1_npy(spark, sf_dir) -> DataFrame:
    """Patches as NPY files and back."""

    def build(r: dict) -> bytes:
        out = io.BytesIO()
        np.save(out, np.array(r["embedding"], np.float32).reshape(1, 8, 8))
        return out.getvalue()

    return sums(with_bytes(patches(spark, sf_dir), build), lambda x: np.load(io.BytesIO(x), allow_pickle=False))


def log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", c("event_type").alias("source"), (c("value") < 300).alias("ok"))


def stream_failures(spark, sf_dir) -> DataFrame:
    """Failed fetches by source and day, and where their share stops a source."""
    return jobs.fetch_failures(log(spark, sf_dir), "1 day")


def stream_stacks(spark, sf_dir) -> DataFrame:
    """The images of each user in windows of ten days, in order of time."""
    images = table(spark, sf_dir, "events").select("ts", c("user_id").alias("patch"), c("event_id").alias("image"))
    found = jobs.stacks(images, "10 days")
    return found.select("start", "patch", F.size("images").cast("bigint").alias("images"), c("images")[0].alias("first"))


def stream_moments(spark, sf_dir) -> DataFrame:
    found = jobs.running_moments(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_SUM = "SELECT vec_id AS id, CAST({n} AS BIGINT) AS pixels, round(list_sum(list_transform({cells}, lambda x: {value})), 5) AS total FROM embeddings"

QUERIES = {
    "s50_wkb": (s50_wkb, sql("SELECT id, 'Polygon' AS kind, CAST(5 AS BIGINT) AS corners, round(lon, 6) AS x, round(lat, 6) AS y FROM points", POINTS)),
    "s46_geopackage_blobs": (s46_geopackage_blobs, sql("SELECT id, round(lon, 6) AS x, round(lat, 6) AS y FROM points", POINTS)),
    "s41_geojson": (s41_geojson, sql("SELECT id, round(lon, 6) AS x, round(lat, 6) AS y FROM points", POINTS)),
    "s20_geotiff_windows": (s20_geotiff_windows, _SUM.format(n=16, cells="embedding[25:40]", value="CAST(x AS DOUBLE)")),
    "s10_decoded_png": (s10_decoded_png, _SUM.format(n=192, cells="embedding", value="CASE WHEN x > 0 THEN 600e0 ELSE 0e0 END")),
    "w1_npy": (w1_npy, _SUM.format(n=64, cells="embedding", value="CAST(x AS DOUBLE)")),
    "stream_failures": (stream_failures, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS source, count(*) FILTER (WHERE NOT value < 300) AS failed, count(*) AS total, count(*) FILTER (WHERE NOT value < 300) / count(*) > 0.05 AS stop FROM events GROUP BY 1, 2"),
    "stream_stacks": (stream_stacks, "SELECT time_bucket(INTERVAL 10 DAY, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS start, user_id AS patch, count(*) AS images, arg_min(event_id, (ts, event_id)) AS \"first\" FROM events GROUP BY 1, 2"),
    "stream_moments": (stream_moments, "SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type"),
}

"""Raster files as tables of blocks and pixels, and patches as files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.spatial import overlaps
from geoloom.sources import png, tiff

HEADERS = "file string, height long, width long, bands int, dtype string, epsg int, nodata double, transform array<double>"
BLOCKS = "file string, block_row long, block_col long, row long, col long, height int, width int, bands int, dtype string, pixels binary, valid binary"


def _rows(schema_types: list, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema_types, strict=True)], names)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files that a path or glob names."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def geotiff_headers(found: DataFrame) -> DataFrame:
    """A row for each GeoTIFF of files(): size, type, reference system and corner-based transform."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                i = tiff.read_info(content.as_py())
                rows.append((file, i.height, i.width, i.bands, i.dtype.newbyteorder("=").name, i.epsg, i.nodata, None if i.transform is None else list(i.transform)))
            if rows:
                yield _rows([pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64())], [x.split()[0] for x in HEADERS.split(", ")], rows)

    return found.select("path", "content").mapInArrow(run, HEADERS)


def window_of(transform: tuple[float, ...] | None, bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """Rows and columns (r0, r1, c0, c1) of the pixels that a box (west, south, east, north) of the raster's own system meets."""
    if transform is None:
        raise ValueError("a raster without a place can't be cut to a region")
    a, b, x, d, e, y = transform
    det = a * e - b * d
    corners = [((e * (u - x) - b * (v - y)) / det, (a * (v - y) - d * (u - x)) / det) for u in bounds[::2] for v in bounds[1::2]]
    cols, rows = zip(*corners, strict=True)
    low, high = lambda v: int(np.floor(min(v) + 1e-9)), lambda v: int(np.ceil(max(v) - 1e-9))
    return low(rows), high(rows), low(cols), high(cols)


def geotiff_blocks(found: DataFrame, side: int = 512, window: tuple[int, int, int, int] | None = None, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Square blocks of pixels of the GeoTIFFs of files(); of a window (r0, r1, c0, c1), or of bounds (west, south, east,
    north), only the chunks that it meets are decoded.

    valid has a byte for each pixel: inside the raster and not NoData.
    """
    types = [pa.string(), *[pa.int64()] * 4, *[pa.int32()] * 3, pa.string(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                info = tiff.read_info(data)
                r0, r1, c0, c1 = window_of(info.transform, bounds) if bounds else window or (0, info.height, 0, info.width)
                r0, r1, c0, c1 = max(0, r0), min(info.height, r1), max(0, c0), min(info.width, c1)
                for br in range(r0 // side, -(-r1 // side)):
                    for bc in range(c0 // side, -(-c1 // side)):
                        y0, y1, x0, x1 = max(r0, br * side), min(r1, (br + 1) * side), max(c0, bc * side), min(c1, (bc + 1) * side)
                        pixels, valid = tiff.read_window(data, info, y0, y1, x0, x1)
                        valid &= ~empty(pixels, info.nodata)
                        yield _rows(types, names, [(file, br, bc, y0, x0, y1 - y0, x1 - x0, info.bands, pixels.dtype.name, pixels.tobytes(), valid.tobytes())])

    return found.select("path", "content").mapInArrow(run, BLOCKS)


def empty(pixels: np.ndarray, nodata: float | None) -> np.ndarray:
    """Where all bands are NoData, or none is finite."""
    out = np.zeros(pixels.shape[:2], bool)
    if pixels.dtype.kind == "f":
        out |= ~np.isfinite(pixels).any(axis=2)
    if nodata is not None and nodata == nodata:
        out |= (pixels == nodata).all(axis=2)
    return out


def pixels(blocks: DataFrame) -> DataFrame:
    """file, r, c, values (array of doubles by band), valid of each pixel of geotiff_blocks."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for b in batch.to_pylist():
                shape = (b["height"], b["width"], b["bands"])
                values = np.frombuffer(b["pixels"], b["dtype"]).reshape(shape).astype(np.float64)
                n = shape[0] * shape[1]
                at = np.arange(n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * shape[2] + 1, shape[2]), pa.int32()), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([b["file"]] * n, pa.string()), pa.array(b["row"] + at // shape[1]), pa.array(b["col"] + at % shape[1]), lists, pa.array(np.frombuffer(b["valid"], bool))], ["file", "r", "c", "values", "valid"])

    return blocks.mapInArrow(run, "file string, r long, c long, values array<double>, valid boolean")


def mosaic(pixel_table: DataFrame, offsets: DataFrame) -> DataFrame:
    """r, c, values on a common grid: of overlapping files the first by name with data. offsets: file, row_offset, col_offset."""
    placed = pixel_table.where("valid").join(offsets, "file").select("file", (F.col("r") + F.col("row_offset")).alias("r"), (F.col("c") + F.col("col_offset")).alias("c"), "values")
    return placed.groupBy("r", "c").agg(F.min_by("values", "file").alias("values"))


def decoded_tiles(tiles: DataFrame, data: str = "content") -> DataFrame:
    """tiles with rgb (256 x 256 x 3 bytes) of their PNG; null where a body is no such image."""
    at = tiles.columns.index(data)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema] + ["rgb binary"])

    def one(body: bytes | None) -> bytes | None:
        try:
            image = png.decode(body or b"")
        except (ValueError, IndexError, png.zlib.error, png.struct.error):
            return None
        return image.tobytes() if image.shape == (256, 256, 3) else None

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(x) for x in batch.column(at).to_pylist()], pa.binary())], [*batch.schema.names, "rgb"])

    return tiles.mapInArrow(run, schema)


def encoded(patches: DataFrame, image_format: str) -> DataFrame:
    """patches (name, height, width, bands, dtype, pixels, ...) with content: PNG, NPY or TIFF bytes."""
    if image_format not in ("png", "npy", "tif"):
        raise ValueError("patches are written as png, npy or tif")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema] + ["content binary"])
    places = {n: patches.columns.index(n) for n in ("height", "width", "bands", "dtype", "pixels")}

    def one(height: int, width: int, bands: int, dtype: str, raw: bytes) -> bytes:
        image = np.frombuffer(raw, dtype).reshape(height, width, bands)
        if image_format == "png":
            return png.encode(image.astype(np.uint8, casting="safe"))
        if image_format == "tif":
            return tiff.write(image)
        out = io.BytesIO()
        np.save(out, np.ascontiguousarray(np.moveaxis(image, -1, 0)))
        return out.getvalue()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            columns = [batch.column(i).to_pylist() for i in places.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(*x) for x in zip(*columns, strict=True)], pa.binary())], [*batch.schema.names, "content"])

    return patches.mapInArrow(run, schema)


def save_files(files: DataFrame, uri: str) -> DataFrame:
    """Write files (name, content) under a shared folder's URI; gives name, bytes, sha256.

    Each is written under another name and moved, so that a task that is run again leaves whole files.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for batch in found:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, content in zip(names, contents, strict=True):
                target = f"{root}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(x) for x in contents], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in contents], pa.string())], ["name", "bytes", "sha256"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes long, sha256 string")


def npy_bytes(content):
    """Bytes that an NPY file has by its header: version 1, a shape and a type."""
    byte = lambda k: F.conv(F.hex(F.substring(content, k, 1)), 16, 10).cast("bigint")
    length = byte(9) + 256 * byte(10)
    head = F.decode(F.substring(content, F.lit(11), length.cast("int")), "ISO-8859-1")
    sides = F.filter(F.split(F.regexp_extract(head, r"\(([^)]*)\)", 1), ","), lambda x: F.trim(x) != "")
    values = F.aggregate(sides, F.lit(1).cast("bigint"), lambda n, x: n * F.trim(x).cast("bigint"))
    return 10 + length + values * F.nullif(F.regexp_extract(head, r"'[<>|=]?[a-zA-Z](\d+)'", 1), F.lit("")).cast("bigint")


def cut_short(found: DataFrame) -> DataFrame:
    """path, problem of files() that aren't whole by their first and last bytes, NPY files by their length.

    Spark's readers skip files without bytes: those show as missing against the list of files.
    """
    content = F.col("content")
    starts = lambda text: F.substring(content, 1, len(text)) == F.lit(text)
    ends = lambda text: F.substring(content, -len(text), len(text)) == F.lit(text)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    tif = F.lit(False)
    for mark in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        tif = tif | starts(mark)
    problem = (
        F.when((suffix == "png") & ~starts(png.SIGNATURE), "is not a PNG file")
        .when((suffix == "png") & ~ends(png.END), "is cut short")
        .when(suffix.isin("jpg", "jpeg") & ~starts(b"\xff\xd8"), "is not a JPEG file")
        .when(suffix.isin("jpg", "jpeg") & ~ends(b"\xff\xd9"), "is cut short")
        .when(suffix.isin("tif", "tiff") & ~tif, "is not a TIFF file")
        .when((suffix == "npy") & ~starts(b"\x93NUMPY"), "is not an NPY file")
        .when((suffix == "npy") & (F.octet_length(content) != npy_bytes(content)), "is cut short")
    )
    return found.select("path", problem.alias("problem")).where("problem is not null")


def checksums(found: DataFrame) -> DataFrame:
    """path, sha256 of files()."""
    return found.select("path", F.sha2("content", 256).alias("sha256"))


def fingerprints(found: DataFrame, head: int = 1 << 16) -> DataFrame:
    """path, size, head_sha256 of files(): enough to tell that a source has changed without hashing all of it."""
    return found.select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2(F.substring("content", 1, head), 256).alias("head_sha256"))


def read_patch(content: bytes, suffix: str) -> np.ndarray:
    """A patch's pixels (bands, rows, columns) from NPY, PNG or TIFF bytes."""
    if suffix == "npy":
        return np.load(io.BytesIO(content), allow_pickle=False)
    if suffix == "png":
        return np.moveaxis(png.decode(content), -1, 0)
    if suffix in ("tif", "tiff"):
        info = tiff.read_info(content)
        return np.moveaxis(tiff.read_window(content, info, 0, info.height, 0, info.width)[0], -1, 0)
    raise ValueError(f"no patches are read from .{suffix} files")


def rgb(blocks: DataFrame) -> DataFrame:
    """Blocks of one band as three equal ones; others as they are."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            bands, dtypes = batch.column(7).to_pylist(), batch.column(8).to_pylist()
            pixels = [np.repeat(np.frombuffer(p, d), 3).tobytes() if n == 1 else p for p, n, d in zip(batch.column(9).to_pylist(), bands, dtypes, strict=True)]
            columns = list(batch.columns)
            columns[7], columns[9] = pa.array([3 if n == 1 else n for n in bands], pa.int32()), pa.array(pixels, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return blocks.mapInArrow(run, BLOCKS)


def extracted(blocks: DataFrame, patches: DataFrame, size: int, reflect: bool = False) -> DataFrame:
    """patch, height, width, bands, dtype, pixels, valid, n_valid: the patches (patch, row, col) cut from blocks of one grid.

    A pixel is that of the first file, by name, with data there. What lies beyond all blocks is 0 and
    not valid, or with reflect mirrors what is seen, if that is two pixels or more either way. Blocks
    meet patches by cells and pass through a task patch by patch, as a stream.
    """
    boxes = blocks.select(F.lit(0).alias("feature"), F.col("row").alias("r0"), (F.col("row") + F.col("height")).alias("r1"), F.col("col").alias("c0"), (F.col("col") + F.col("width")).alias("c1"), "file", "bands", "dtype", "pixels", "valid")
    meet = overlaps(patches.select("patch", "row", "col"), boxes, size).select("patch", "row", "col", "file", "r0", "r1", "c0", "c1", "bands", "dtype", "pixels", "valid")

    def cut(rows: list[dict]) -> tuple:
        first = rows[0]
        out, there = np.zeros((size, size, first["bands"]), first["dtype"]), np.zeros((size, size), bool)
        high = wide = 0
        for b in rows:
            shape = (b["r1"] - b["r0"], b["c1"] - b["c0"])
            values, valid = np.frombuffer(b["pixels"], b["dtype"]).reshape(*shape, b["bands"]), np.frombuffer(b["valid"], bool).reshape(shape)
            y0, y1, x0, x1 = max(b["r0"], b["row"]), min(b["r1"], b["row"] + size), max(b["c0"], b["col"]), min(b["c1"], b["col"] + size)
            inner, outer = (slice(y0 - b["r0"], y1 - b["r0"]), slice(x0 - b["c0"], x1 - b["c0"])), (slice(y0 - b["row"], y1 - b["row"]), slice(x0 - b["col"], x1 - b["col"]))
            new = valid[inner] & ~there[outer]
            out[outer][new] = values[inner][new]
            there[outer] |= new
            high, wide = max(high, y1 - b["row"]), max(wide, x1 - b["col"])
        if reflect and min(high, wide) >= 2:
            mirror = lambda n: np.minimum(np.arange(size) % (2 * n - 2), 2 * n - 2 - np.arange(size) % (2 * n - 2))
            out = out[mirror(high)][:, mirror(wide)]
        return first["patch"], size, size, first["bands"], first["dtype"], out.tobytes(), there.tobytes(), int(there.sum())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [pa.int64(), *[pa.int32()] * 3, pa.string(), pa.binary(), pa.binary(), pa.int64()], ["patch", "height", "width", "bands", "dtype", "pixels", "valid", "n_valid"]
        held: list[dict] = []
        for batch in found:
            for row in batch.to_pylist():
                if held and held[0]["patch"] != row["patch"]:
                    yield _rows(types, names, [cut(held)])
                    held = []
                held.append(row)
        if held:
            yield _rows(types, names, [cut(held)])

    return meet.repartition("patch").sortWithinPartitions("patch", "file", "r0", "c0").mapInArrow(run, "patch long, height int, width int, bands int, dtype string, pixels binary, valid binary, n_valid long")


def stacked(images: DataFrame) -> DataFrame:
    """patch, content: the images (patch, time, height, width, bands, dtype, pixels) of each patch in order of time as NPY (T, C, H, W)."""
    held = images.groupBy("patch", "height", "width", "bands", "dtype").agg(F.sort_array(F.collect_list(F.struct("time", "pixels")))["pixels"].alias("pixels"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            contents = []
            for r in batch.to_pylist():
                out = io.BytesIO()
                shape = (r["height"], r["width"], r["bands"])
                np.save(out, np.ascontiguousarray(np.stack([np.moveaxis(np.frombuffer(p, r["dtype"]).reshape(shape), -1, 0) for p in r["pixels"]])))
                contents.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["patch", "content"])

    return held.mapInArrow(run, "patch long, content binary")

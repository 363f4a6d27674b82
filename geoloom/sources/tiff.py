"""TIFF and GeoTIFF in numpy: classic and BigTIFF, either byte order; strips and tiles; none, LZW, Deflate and PackBits with
predictors 1 to 3; and a writer of uncompressed or Deflate strips. Layout numbers are fixed values of the format."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
SCALE, TIE, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
MOST_BLOCK = 1 << 30


class Unsupported(ValueError):
    """A file of a kind that is not read."""


@dataclass
class Info:
    """What a file's first directory says."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    transform: tuple[float, ...] | None
    epsg: int | None
    nodata: float | None
    tags: dict = field(repr=False)
    order: str = "<"

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a chunk."""
        if TILE_WIDTH in self.tags:
            return self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]
        return min(self.tags.get(ROWS, (self.height,))[0], self.height), self.width


def read_info(data: bytes) -> Info:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise Unsupported("no TIFF file")
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version == 42:
        start, count, size, inline = struct.unpack_from(order + "I", data, 4)[0], "H", 12, 4
    elif version == 43:
        start, count, size, inline = struct.unpack_from(order + "Q", data, 8)[0], "Q", 20, 8
    else:
        raise Unsupported(f"TIFF version {version}")
    n = struct.unpack_from(order + count, data, start)[0]
    at, tags = start + struct.calcsize(count), {}
    for i in range(n):
        place = at + i * size
        tag, kind = struct.unpack_from(order + "HH", data, place)
        many = struct.unpack_from(order + ("I" if inline == 4 else "Q"), data, place + 4)[0]
        if kind not in TYPES:
            continue
        layout = f"{order}{many}s" if kind == 2 else order + TYPES[kind] * min(many, len(data))
        value_at = place + 4 + inline
        if struct.calcsize(layout) > inline:
            value_at = struct.unpack_from(order + ("I" if inline == 4 else "Q"), data, value_at)[0]
        tags[tag] = struct.unpack_from(layout, data, value_at)
    bits, form = tags.get(BITS, (1,)), tags.get(FORMAT, (1,))[0]
    if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or form not in (1, 2, 3):
        raise Unsupported("samples of this kind")
    dtype = np.dtype(f"{order}{'uif'[form - 1]}{bits[0] // 8}")
    text = tags.get(NODATA, (b"",))[0].split(b"\0")[0].strip()
    transform, epsg = georeference(tags)
    return Info(tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0], dtype, transform, epsg, float(text) if text else None, tags, order)


def georeference(tags: dict) -> tuple[tuple[float, ...] | None, int | None]:
    """Corner-based transform and EPSG code."""
    keys = tags.get(GEO_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = next((found[k] for k in (3072, 2048) if 0 < found.get(k, 0) < 32767), None)
    t = None
    if MATRIX in tags:
        m = tags[MATRIX]
        t = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIE in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIE][:5]
        t = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    if t is not None and found.get(1025) == 2:  # the tie is a pixel's centre
        a, b, c, d, e, f = t
        t = (a, b, c - (a + b) / 2, d, e, f - (d + e) / 2)
    return t, epsg


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Variable-width codes from the high bit, widths growing one code early; 256 clears, 257 ends."""
    out, table, previous = bytearray(), [], b""
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, previous, width = [], b"", 9
                continue
            if code < 256:
                entry = bytes((code,))
            elif code - 258 < len(table):
                entry = table[code - 258]
            elif previous:
                entry = previous + previous[:1]
            else:
                raise ValueError("a broken LZW stream")
            out += entry
            if previous:
                table.append(previous + entry[:1])
            previous = entry
            width = 9 + (len(table) + 258 >= 511) + (len(table) + 258 >= 1023) + (len(table) + 258 >= 2047)
    return bytes(out)


def decode_block(info: Info, raw: bytes, rows: int, cols: int, samples: int) -> np.ndarray:
    """[rows, cols, samples] of a chunk, native byte order."""
    size = rows * cols * samples * info.dtype.itemsize
    if size > MOST_BLOCK:
        raise Unsupported("a chunk of over 1 GiB")
    how = info.tags.get(COMPRESSION, (1,))[0]
    if how in (8, 32946):
        raw = zlib.decompressobj().decompress(raw, size)
    elif how in (5, 32773):
        raw = (lzw if how == 5 else unpack_bits)(raw)
    elif how != 1:
        raise Unsupported(f"compression {how}")
    raw = raw[:size].ljust(size, b"\0")
    predictor = info.tags.get(PREDICTOR, (1,))[0]
    if predictor == 3:
        step = info.dtype.itemsize
        planes = np.frombuffer(raw, np.uint8).reshape(rows, step * cols * samples)
        lanes = planes.reshape(rows, -1, samples) if samples > 1 else planes[:, :, None]
        planes = np.cumsum(lanes, axis=1, dtype=np.uint8).reshape(rows, step, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{step}").reshape(rows, cols, samples).astype(info.dtype.newbyteorder("="))
    values = np.frombuffer(raw, info.dtype).reshape(rows, cols, samples).astype(info.dtype.newbyteorder("="))
    return np.cumsum(values, axis=1, dtype=values.dtype) if predictor == 2 else values


def read_window(data: bytes, info: Info, r0: int, r1: int, c0: int, c1: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels [rows, cols, bands] and whether each lies in the raster; only chunks that meet the window are decoded."""
    block_r, block_c = info.block
    tiled = TILE_WIDTH in info.tags
    across, down = -(-info.width // block_c), -(-info.height // block_r)
    planar = info.tags.get(PLANAR, (1,))[0] == 2
    planes, samples = (info.bands, 1) if planar else (1, info.bands)
    offsets, counts = (info.tags[k] for k in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (OFFSETS, COUNTS)))
    fill = info.nodata if info.nodata is not None and (info.dtype.kind == "f" or info.nodata == info.nodata) else 0
    out = np.full((r1 - r0, c1 - c0, info.bands), fill, info.dtype.newbyteorder("="))
    for by in range(max(0, r0) // block_r, min(down, -(-max(r1, 0) // block_r))):
        for bx in range(max(0, c0) // block_c, min(across, -(-max(c1, 0) // block_c))):
            rows = block_r if tiled else min(block_r, info.height - by * block_r)
            for plane in range(planes):
                at = (plane * down + by) * across + bx
                if not counts[at]:
                    continue  # a sparse chunk holds no data
                pixels = decode_block(info, data[offsets[at] : offsets[at] + counts[at]], rows, block_c, samples)
                y0, y1 = max(r0, by * block_r, 0), min(r1, by * block_r + rows, info.height)
                x0, x1 = max(c0, bx * block_c, 0), min(c1, (bx + 1) * block_c, info.width)
                if y1 > y0 and x1 > x0:
                    part = pixels[y0 - by * block_r : y1 - by * block_r, x0 - bx * block_c : x1 - bx * block_c]
                    out[y0 - r0 : y1 - r0, x0 - c0 : x1 - c0, plane : plane + samples] = part
    valid = np.zeros(out.shape[:2], bool)
    valid[max(0, -r0) : max(0, info.height - r0), max(0, -c0) : max(0, info.width - c0)] = True
    return out, valid


def write(pixels: np.ndarray, transform: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None, deflate: bool = True, rows_per_strip: int = 64) -> bytes:
    """A little-endian classic TIFF of [rows, cols, bands]."""
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    height, width, bands = pixels.shape
    data = np.ascontiguousarray(pixels.astype(pixels.dtype.newbyteorder("<")))
    strips = [data[r : r + rows_per_strip].tobytes() for r in range(0, height, rows_per_strip)]
    if deflate:
        strips = [zlib.compress(s, 6) for s in strips]
    entries: list[tuple[int, int, list]] = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [pixels.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8 if deflate else 1]), (262, 3, [2 if bands == 3 and pixels.dtype == np.uint8 else 1]), (OFFSETS, 4, [0] * len(strips)), (SAMPLES, 3, [bands]), (ROWS, 4, [rows_per_strip]), (COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [1]), (FORMAT, 3, ["uif".index(pixels.dtype.kind) + 1] * bands)]
    if transform is not None:
        a, b, c, d, e, f = transform
        entries.append((MATRIX, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    if epsg is not None:
        geographic = 4000 <= epsg < 5000
        entries.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]))
    if nodata is not None:
        entries.append((NODATA, 2, [f"{nodata:g}".encode() + b"\0"]))
    entries.sort()
    head = 8 + 2 + 12 * len(entries) + 4
    pack = lambda kind, values: values[0] if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
    extra, at = b"", head
    sizes = {tag: len(pack(kind, values)) for tag, kind, values in entries}
    first = head + sum(n + n % 2 for n in sizes.values() if n > 4)
    place, offsets = first, []
    for s in strips:
        offsets.append(place)
        place += len(s)
    out = b"II" + struct.pack("<HIH", 42, 8, len(entries))
    for tag, kind, values in entries:
        raw = pack(kind, offsets if tag == OFFSETS else values)
        count = len(raw) if kind == 2 else len(values)
        if len(raw) <= 4:
            out += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        else:
            out += struct.pack("<HHII", tag, kind, count, at)
            extra += raw + b"\0" * (len(raw) % 2)
            at += len(raw) + len(raw) % 2
    return out + struct.pack("<I", 0) + extra + b"".join(strips)

"""PNG in numpy: 8-bit gray, RGB, palette and with alpha, not interlaced; and an encoder. Layout numbers are the format's."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
END = b"\0\0\0\0IEND\xaeB`\x82"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode(pixels: np.ndarray) -> bytes:
    """uint8 [rows, cols] or [rows, cols, 1, 3 or 4]."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    height, width, n = pixels.shape
    rows = np.zeros((height, 1 + width * n), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """RGB uint8 [rows, cols, 3]; wholly transparent pixels are black."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG file")
    at, packed, palette, alphas = 8, b"", None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced or color not in CHANNELS:
                raise ValueError("a PNG of this kind is not read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alphas = body
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
    n = CHANNELS[color]
    stride = width * n
    raw = np.frombuffer(zlib.decompressobj().decompress(packed, height * (stride + 1)), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for r in range(height):
        out[r] = above = unfiltered(int(raw[r, 0]), raw[r, 1:], above, n)
    pixels = out.reshape(height, width, n)
    if color == 3:
        alpha = np.frombuffer(alphas.ljust(256, b"\xff"), np.uint8)[pixels[:, :, 0]]
        rgb = palette[pixels[:, :, 0]]
    else:
        rgb = pixels[:, :, :3] if n >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)
        alpha = pixels[:, :, -1] if n in (2, 4) else None
    return rgb.copy() if alpha is None else np.where((alpha == 0)[:, :, None], 0, rgb).astype(np.uint8)


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    values, up, out = row.tolist(), above.tolist(), []
    for i, v in enumerate(values):
        a = out[i - n] if i >= n else 0
        b, d = up[i], up[i - n] if i >= n else 0
        if kind == 3:
            out.append((v + (a + b) // 2) & 255)
        else:
            pa, pb, pd = abs(b - d), abs(a - d), abs(a + b - 2 * d)
            out.append((v + (a if pa <= pb and pa <= pd else b if pb <= pd else d)) & 255)
    return np.array(out, np.uint8)

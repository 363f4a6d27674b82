"""Well-known binary and GeoPackage blobs to and from nested coordinate arrays.

A geometry is a kind and parts: parts is a list of polygons, each a list of rings, each a list of
(x, y). A line is one polygon of one ring, a point one ring of one place.
"""

from __future__ import annotations

import struct

KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {v: k for k, v in KINDS.items()}
MEMBERS = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}
#: Bytes of a GeoPackage header's envelope by its code.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
MOST_DEPTH = 16


class Broken(ValueError):
    """Bytes that are no geometry."""


def parse(data: bytes) -> tuple[str, list]:
    kind, parts, end = _geometry(memoryview(data), 0, 0)
    return kind, parts


def _take(data: memoryview, at: int, layout: str) -> tuple[tuple, int]:
    size = struct.calcsize(layout)
    if at + size > len(data):
        raise Broken("the geometry ends early")
    return struct.unpack_from(layout, data, at), at + size


def _geometry(data: memoryview, at: int, depth: int) -> tuple[str, list, int]:
    if depth > MOST_DEPTH:
        raise Broken("geometries nest too deep")
    (order,), at = _take(data, at, "B")
    if order > 1:
        raise Broken("no byte order")
    e = "<>"[order == 0]
    (code,), at = _take(data, at, e + "I")
    flags, code = code & 0xE0000000, code & 0x1FFFFFFF
    extra = bool(flags & 0x80000000) + bool(flags & 0x40000000) + (0, 1, 1, 2)[min(code // 1000, 3)]
    if flags & 0x20000000:
        _, at = _take(data, at, e + "I")
    kind = KINDS.get(code % 1000)
    if kind is None:
        raise Broken(f"geometry type {code}")
    dims = 2 + extra

    def places(n: int, at: int) -> tuple[list, int]:
        if n * 8 * dims > len(data) - at:
            raise Broken("the geometry ends early")
        values, at = _take(data, at, f"{e}{n * dims}d")
        return list(zip(values[::dims], values[1::dims], strict=True)), at

    if kind == "Point":
        ring, at = places(1, at)
        return kind, [] if ring[0][0] != ring[0][0] else [[ring]], at
    (n,), at = _take(data, at, e + "I")
    if kind == "LineString":
        ring, at = places(n, at)
        return kind, [[ring]] if ring else [], at
    if kind == "Polygon":
        rings = []
        for _ in range(n):
            (m,), at = _take(data, at, e + "I")
            ring, at = places(m, at)
            rings.append(ring)
        return kind, [rings] if rings else [], at
    parts = []
    for _ in range(n):
        _, more, at = _geometry(data, at, depth + 1)
        parts += more
    return kind, parts, at


def build(kind: str, parts: list) -> bytes:
    """Little-endian WKB of a geometry of one kind (no collections)."""
    if kind in MEMBERS:
        return struct.pack("<BII", 1, CODES[kind], len(parts)) + b"".join(build(MEMBERS[kind], [p]) for p in parts)
    head = struct.pack("<BI", 1, CODES[kind])
    flat = lambda ring: struct.pack(f"<{2 * len(ring)}d", *[v for p in ring for v in p])
    if kind == "Point":
        return head + flat(parts[0][0] if parts else [(float("nan"), float("nan"))])
    if kind == "LineString":
        ring = parts[0][0] if parts else []
        return head + struct.pack("<I", len(ring)) + flat(ring)
    rings = parts[0] if parts else []
    return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + flat(r) for r in rings)


def from_geopackage(blob: bytes | None) -> bytes | None:
    """The WKB in a GeoPackage blob; null where it is empty."""
    if not blob:
        return None
    if blob[:2] != b"GP" or len(blob) < 8:
        raise Broken("no GeoPackage geometry")
    flags = blob[3]
    if flags & 0x10:
        return None
    envelope = ENVELOPES.get(flags >> 1 & 7)
    if envelope is None:
        raise Broken("no such envelope")
    return blob[8 + envelope :]

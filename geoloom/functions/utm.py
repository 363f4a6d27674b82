"""Transverse Mercator on WGS 84 as Column expressions, and on arrays: Krueger's series to the sixth order, as published."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WGS 84 and of the UTM grid.
A, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880,
    49561 * N**4 / 161280 - 179 * N**5 / 168,
    34729 * N**5 / 80640,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480,
    4397 * N**4 / 161280 - 11 * N**5 / 504,
    4583 * N**5 / 161280,
)
E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _sum(parts) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """Struct x, y in metres in the UTM zone of an EPSG code 326xx or 327xx."""
    zone = epsg % 100
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - E * F.atanh(E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + _sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    y = xi + _sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    south = F.when(epsg >= 32700, FALSE_NORTH).otherwise(0.0)
    return F.struct((FALSE_EAST + SCALE * RECTIFYING * x).alias("x"), (south + SCALE * RECTIFYING * y).alias("y"))


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """Struct lon, lat in degrees."""
    south = F.when(epsg >= 32700, FALSE_NORTH).otherwise(0.0)
    xi, eta = (y - south) / (SCALE * RECTIFYING), (x - FALSE_EAST) / (SCALE * RECTIFYING)
    u = xi - _sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    v = eta - _sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    conformal = F.sin(u) / F.cosh(v)
    q = F.atanh(conformal)
    s = F.tanh(q)
    for _ in range(5):  # the latitude of an isometric one, by fixed-point steps of factor 0.0067
        s = F.tanh(q + E * F.atanh(E * s))
    lon = F.degrees(F.atan2(F.sinh(v), F.cos(u))) + ((epsg % 100) * 6 - 183)
    return F.struct(lon.alias("lon"), F.degrees(F.asin(s)).alias("lat"))


def _series(factors: tuple[float, ...], re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of factors[j - 1] * sin(2 j z) at z = re + i im, by Clenshaw's recurrence."""
    s, co, sh, ch = np.sin(2 * re), np.cos(2 * re), np.sinh(2 * im), np.cosh(2 * im)
    twice = 2 * (co * ch - 1j * s * sh)
    b, after = np.zeros_like(twice), np.zeros_like(twice)
    for f in reversed(factors):
        b, after = f + twice * b - after, b
    out = (s * ch + 1j * co * sh) * b
    return out.real, out.imag


def array_to_utm(lon: np.ndarray, lat: np.ndarray, epsg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """to_utm() of arrays: x and y."""
    phi, lam = np.radians(lat), np.radians(lon - (epsg % 100 * 6 - 183))
    s = np.sin(phi)
    t = np.sinh(np.arctanh(s) - E * np.arctanh(E * s))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    y, x = _series(ALPHA, xi, eta)
    return FALSE_EAST + SCALE * RECTIFYING * (eta + x), np.where(epsg >= 32700, FALSE_NORTH, 0.0) + SCALE * RECTIFYING * (xi + y)


def array_from_utm(x: np.ndarray, y: np.ndarray, epsg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """from_utm() of arrays: lon and lat."""
    xi, eta = (y - np.where(epsg >= 32700, FALSE_NORTH, 0.0)) / (SCALE * RECTIFYING), (x - FALSE_EAST) / (SCALE * RECTIFYING)
    du, dv = _series(BETA, xi, eta)
    u, v = xi - du, eta - dv
    q = np.arctanh(np.sin(u) / np.cosh(v))
    s = np.tanh(q)
    for _ in range(5):
        s = np.tanh(q + E * np.arctanh(E * s))
    return np.degrees(np.arctan2(np.sinh(v), np.cos(u))) + (epsg % 100 * 6 - 183), np.degrees(np.arcsin(s))

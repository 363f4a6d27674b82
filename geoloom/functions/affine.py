"""Affine pixel transforms (struct a, b, c, d, e, f; x = a col + b row + c, y = d col + e row + f) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("a", "b", "c", "d", "e", "f")
GRID_SLACK = 1e-9
EDGE_SLACK = 1e-6


def affine(*values: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(FIELDS, values, strict=True)])


def apply(t: Column, col: Column, row: Column) -> Column:
    """Struct x, y of a pixel corner."""
    return F.struct((t["c"] + col * t["a"] + row * t["b"]).alias("x"), (t["f"] + col * t["d"] + row * t["e"]).alias("y"))


def inverse(t: Column) -> Column:
    """The transform back to pixels; null where there is none."""
    a, b, c, d, e, f = (t[n] for n in FIELDS)
    det = a * e - b * d
    largest = F.greatest(F.abs(a), F.abs(b), F.abs(d), F.abs(e))
    straight = affine(1 / F.nullif(a, F.lit(0.0)), F.lit(0.0), -c / F.nullif(a, F.lit(0.0)), F.lit(0.0), 1 / F.nullif(e, F.lit(0.0)), -f / F.nullif(e, F.lit(0.0)))
    safe = F.nullif(det, F.lit(0.0))
    turned = affine(e / safe, -b / safe, (b * f - e * c) / safe, -d / safe, a / safe, (d * c - a * f) / safe)
    singular = F.abs(det) <= 1e-10 * largest * largest
    return F.when((b == 0) & (d == 0), F.when((a != 0) & (e != 0), straight)).when(~singular, turned)


def moved(t: Column, row: Column, col: Column) -> Column:
    """The transform of a window whose first pixel is (row, col)."""
    at = apply(t, col, row)
    return affine(t["a"], t["b"], at["x"], t["d"], t["e"], at["y"])


def patch_bounds(t: Column, row: Column, col: Column, size: Column) -> Column:
    """Struct west, south, east, north over the four corners of a square patch."""
    corners = [apply(t, col + dc * size, row + dr * size) for dr in (0, 1) for dc in (0, 1)]
    xs, ys = [p["x"] for p in corners], [p["y"] for p in corners]
    return F.struct(F.least(*xs).alias("west"), F.least(*ys).alias("south"), F.greatest(*xs).alias("east"), F.greatest(*ys).alias("north"))


def snapped_interval(low: Column, high: Column, origin: Column, step: Column) -> Column:
    """Struct low, high grown to the grid lines origin + k step; an edge on a line, but for noise, stays."""
    return F.struct((origin + F.floor((low - origin) / step + GRID_SLACK) * step).alias("low"), (origin + F.ceil((high - origin) / step - GRID_SLACK) * step).alias("high"))


def pixel_window(bounds: Column, t: Column, height: Column, width: Column) -> Column:
    """Struct row0, row1, col0, col1, beyond: the pixels that cover a box, clipped to the raster."""
    a, b, c, d, e, f = (t[n] for n in FIELDS)
    det = F.nullif(a * e - b * d, F.lit(0.0))
    corners = [(bounds[x], bounds[y]) for x in ("west", "east") for y in ("south", "north")]
    cols = [(e * (x - c) - b * (y - f)) / det for x, y in corners]
    rows = [(a * (y - f) - d * (x - c)) / det for x, y in corners]
    low_c, high_c, low_r, high_r = F.least(*cols), F.greatest(*cols), F.least(*rows), F.greatest(*rows)
    beyond = (low_c < -EDGE_SLACK) | (low_r < -EDGE_SLACK) | (high_c > width + EDGE_SLACK) | (high_r > height + EDGE_SLACK)
    down = lambda v: F.greatest(F.lit(0).cast("bigint"), F.floor(v + GRID_SLACK))
    up = lambda v, most: F.least(most.cast("bigint"), F.ceil(v - GRID_SLACK))
    return F.struct(down(low_r).alias("row0"), up(high_r, height).alias("row1"), down(low_c).alias("col0"), up(high_c, width).alias("col1"), beyond.alias("beyond"))


def world_file(t: Column) -> Column:
    """Six lines: pixel sizes and turns, then the centre of the first pixel."""
    centre = apply(t, F.lit(0.5), F.lit(0.5))
    values = [t["a"], t["d"], t["b"], t["e"], centre["x"], centre["y"]]
    return F.concat(*[F.concat(v.cast("string"), F.lit("\n")) for v in values])


def epsg(crs: Column) -> Column:
    """The code of 'EPSG:<code>' where it fits a GeoKey, else null."""
    code = F.try_to_number(F.regexp_extract(crs, r"(?i)^EPSG:(\d{1,9})$", 1), F.lit("999999999")).cast("bigint")
    return F.when(code.between(1, 32766), code)


def is_geographic(code: Column) -> Column:
    return code.between(4000, 4999)


def alignment(reference: Column, other: Column) -> Column:
    """Struct factor, row_offset, col_offset, problem: how a grid lies on a finer one with the same corners' lines."""
    factor = other["a"] / reference["a"]
    whole = F.round(factor)
    col, row = (other["c"] - reference["c"]) / reference["a"], (other["f"] - reference["f"]) / reference["e"]
    off = lambda v: F.abs(v - F.round(v)) > EDGE_SLACK
    problem = F.when((reference["b"] != other["b"]) | (reference["d"] != other["d"]), "turned").when((whole < 1) | (F.abs(factor - whole) > GRID_SLACK) | (F.abs(other["e"] / reference["e"] - whole) > GRID_SLACK), "factor").when(off(col) | off(row), "offset").otherwise("")
    return F.struct(whole.cast("bigint").alias("factor"), F.round(row).cast("bigint").alias("row_offset"), F.round(col).cast("bigint").alias("col_offset"), problem.alias("problem"))

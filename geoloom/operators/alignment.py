"""Rasters on other rasters' grids: coarser sources, label rasters, lookups of values as classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import tiles as T
from geoloom.functions import utm

c = F.col
#: Added to a pixel coordinate before it is cut, so that noise at an edge doesn't lead into the pixel before.
NUDGE = 1e-10
IGNORE = 255


def coarse_pixel(r: Column, k: Column, factor: Column | int, row_offset: Column | int, col_offset: Column | int) -> tuple[Column, Column]:
    """The pixel of a coarser raster that lies over a fine one."""
    return F.floor((r - row_offset) / factor), F.floor((k - col_offset) / factor)


def on_grid(fine: DataFrame, coarse: DataFrame, factor: int, row_offset: int, col_offset: int) -> DataFrame:
    """fine (r, c, ...) with value and valid of a coarser raster (r, c, value): 0 and false beyond it."""
    rr, cc = coarse_pixel(c("r"), c("c"), factor, row_offset, col_offset)
    other = coarse.select(c("r").alias("__rr"), c("c").alias("__cc"), c("value").alias("__value"))
    found = fine.withColumns({"__rr": rr, "__cc": cc}).join(other, ["__rr", "__cc"], "left")
    return found.select(*[c(x) for x in fine.columns], F.coalesce("__value", F.lit(0)).alias("value"), c("__value").isNotNull().alias("valid"))


def valid_everywhere(sources: DataFrame, by: Sequence[str], valid: Column) -> DataFrame:
    """by, valid: whether every source has a pixel."""
    return sources.groupBy(*by).agg(F.bool_and(valid).alias("valid"))


def stackable(sources: DataFrame, by: Sequence[str], bands: str, dtype: str) -> DataFrame:
    """by, stackable, sources: whether the sources of a group agree in bands and type."""
    return sources.groupBy(*by).agg((F.count_distinct(F.struct(bands, dtype)) == 1).alias("stackable"), F.count(F.lit(1)).alias("sources"))


def composed(image: Sequence[float], label: Sequence[float]) -> tuple[float, ...]:
    """From the pixels of one grid to those of another of the same reference system: one affine transform."""
    a, b, x, d, e, y = image
    la, lb, lx, ld, le, ly = label
    det = la * le - lb * ld
    if not det:
        raise ValueError("the label raster's transform has no inverse")
    ia, ib, id_, ie = le / det, -lb / det, -ld / det, la / det
    return ia * a + ib * d, ia * b + ib * e, ia * (x - lx) + ib * (y - ly), id_ * a + ie * d, id_ * b + ie * e, id_ * (x - lx) + ie * (y - ly)


def reprojected(x: Column, y: Column, source: int, target: int) -> Column:
    """Struct x, y of a place in another reference system: degrees, Web Mercator, UTM zones."""
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    if source == 4326:
        at = F.struct(x.alias("lon"), y.alias("lat"))
    elif source == 3857:
        at = T.from_mercator(x, y)
    else:
        at = utm.from_utm(x, y, F.lit(source))
    if target == 4326:
        return F.struct(at["lon"].alias("x"), at["lat"].alias("y"))
    return T.mercator(at["lon"], at["lat"]) if target == 3857 else utm.to_utm(at["lon"], at["lat"], F.lit(target))


def label_pixel(r: Column, k: Column, image: Sequence[float], label: Sequence[float], height: int, width: int, systems: tuple[int, int] | None = None) -> Column:
    """Struct r, c of the label raster's pixel under the centre of an imagery pixel, -1 beyond it.

    Within one reference system the two transforms are one; where neither is turned, that reads the
    row from the row alone and the column from the column. Other systems go through the place itself,
    for every pixel, so that no interpolation is needed.
    """
    u, v = k + 0.5, r + 0.5
    if systems is None or systems[0] == systems[1]:
        a, b, x, d, e, y = composed(image, label)
        col = u * a + x if not b else u * a + v * b + x
        row = v * e + y if not d else u * d + v * e + y
    else:
        a, b, x, d, e, y = image
        at = reprojected(x + u * a + v * b, y + u * d + v * e, *systems)
        a, b, x, d, e, y = composed((1, 0, 0, 0, 1, 0), label)
        col, row = at["x"] * a + at["y"] * b + x, at["x"] * d + at["y"] * e + y

    def inside(value: Column, n: int) -> Column:
        whole = F.floor(value + NUDGE)
        return F.when((whole >= 0) & (whole < n), whole).otherwise(-1).cast("bigint")

    return F.struct(inside(row, height).alias("r"), inside(col, width).alias("c"))


def classified(value: Column, classes: Mapping[int, int], ignored: Sequence[int] = (), unmapped: int = 0, ignore: int = IGNORE) -> Column:
    """The class of a raster value: ignored values, then given classes, then `unmapped` (0, or ignore)."""
    pairs = F.create_map(*[F.lit(int(x)).cast("bigint") for item in classes.items() for x in item]) if classes else None
    known = F.try_element_at(pairs, value.cast("bigint")) if classes else F.lit(None)
    out = F.coalesce(known, F.lit(unmapped)).cast("bigint")
    hidden = value.isNull() | (value.isin(*[int(x) for x in ignored]) if ignored else F.lit(False))
    return F.when(hidden, F.lit(ignore).cast("bigint")).otherwise(out)


def any_overlap(boxes: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """by, overlaps: whether a group has a pixel box on the first height x width pixels."""
    return boxes.groupBy(*by).agg(F.bool_or((c("r0") < height) & (c("c0") < width) & (c("r1") > 0) & (c("c1") > 0)).alias("overlaps"))


def label_masks(pixels: DataFrame, labels: DataFrame, by: Sequence[str], image: Sequence[float], label: Sequence[float], shape: tuple[int, int], classes: Mapping[int, int], ignored: Sequence[int] = (), unmapped: int = 0, ignore: int = IGNORE, systems: tuple[int, int] | None = None) -> DataFrame:
    """by, r, c, class_id of imagery pixels by the label raster (r, c, value) under them; ignore beyond it."""
    at = label_pixel(c("r"), c("c"), image, label, *shape, systems)
    placed = pixels.select(*by, "r", "c", at["r"].alias("__r"), at["c"].alias("__c"))
    found = placed.join(labels.select(c("r").alias("__r"), c("c").alias("__c"), "value"), ["__r", "__c"], "left")
    return found.select(*by, "r", "c", classified(c("value"), classes, ignored, unmapped, ignore).alias("class_id"))


def padded_values(values: DataFrame, valid: Column, value: str = "value") -> DataFrame:
    """values with those that aren't valid, padding too, as not-a-number."""
    return values.withColumn(value, F.when(valid, c(value)).otherwise(float("nan")))

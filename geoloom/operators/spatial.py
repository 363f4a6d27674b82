"""Joins of patches with pixel boxes and pixels, by grid cells: equi-joins that Spark can shuffle, never nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: Pixels along the side of a cell.
CELL = 256


def cells(r0: Column, r1: Column, c0: Column, c1: Column, side: int) -> Column:
    """Array of the cells (cr, cc) that a half-open box reaches into."""
    div = lambda v: F.floor(v / side).cast("bigint")
    rows, cols = F.sequence(div(r0), div(r1 - 1)), F.sequence(div(c0), div(c1 - 1))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda k: F.struct(r.alias("cr"), k.alias("cc")))))


def overlaps(patches: DataFrame, boxes: DataFrame, size: int, side: int = CELL) -> DataFrame:
    """Every patch (patch, row, col; size pixels square) with every box (feature, r0, r1, c0, c1, ...) it shares area with.

    Both go once to each cell they reach into; a pair that meets in several is kept in the first of
    them alone, so nothing has to be made distinct. Adds the common box v0, v1, h0, h1 (rows, columns).
    """
    a = patches.withColumns({"__r1": c("row") + size, "__c1": c("col") + size})
    a = a.select("*", F.inline(cells(c("row"), c("__r1"), c("col"), c("__c1"), side)))
    b = boxes.where("r1 > r0 and c1 > c0").select("*", F.inline(cells(c("r0"), c("r1"), c("c0"), c("c1"), side)))
    meet = a.join(b, ["cr", "cc"]).withColumns({"v0": F.greatest("row", "r0"), "v1": F.least("__r1", "r1"), "h0": F.greatest("col", "c0"), "h1": F.least("__c1", "c1")})
    first = (c("cr") == F.floor(c("v0") / side)) & (c("cc") == F.floor(c("h0") / side))
    return meet.where((c("v1") > c("v0")) & (c("h1") > c("h0")) & first).drop("cr", "cc", "__r1", "__c1")


def kept(patches: DataFrame, areas: DataFrame, size: int) -> DataFrame:
    """The patches that share area with an area of interest."""
    found = overlaps(patches, areas, size).select("patch").distinct()
    return patches.join(found, "patch", "left_semi")


def region_of(patches: DataFrame, areas: DataFrame, size: int) -> DataFrame:
    """patch, name: the area (feature, name, box) with most of the patch; of equals the one that appears first; '' where none."""
    order = areas.groupBy("name").agg(F.min("feature").alias("first"))
    shares = overlaps(patches, areas, size).groupBy("patch", "name").agg(F.sum((c("v1") - c("v0")) * (c("h1") - c("h0"))).alias("area"))
    best = shares.join(order, "name").groupBy("patch").agg(F.max_by("name", F.struct("area", (-c("first")).alias("o"))).alias("name"))
    return patches.select("patch").join(best, "patch", "left").select("patch", F.coalesce("name", F.lit("")).alias("name"))


def filled_spans(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, r, c0, c1: even-odd fill of polygons given by edges (by, x0, y0, x1, y1) in pixel coordinates.

    A row is sampled at its centre; an edge counts on rows from its upper end to before its lower
    end; crossings are rounded to the nearest pixel edge and taken in pairs from the left. Where rings
    turn clockwise, a flat edge on a row's centres that runs from right to left is a span of its own.
    """
    from pyspark.sql.window import Window

    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    rows = edges.where("y0 <> y1").withColumns({"__f": first.cast("bigint"), "__l": last.cast("bigint")}).where("__l >= __f")
    rows = rows.withColumn("r", F.explode(F.sequence("__f", "__l")))
    x = c("x0") + (c("r") + 0.5 - c("y0")) * (c("x1") - c("x0")) / (c("y1") - c("y0"))
    rows = rows.select(*by, "r", F.floor(x + 0.5).cast("bigint").alias("x"))
    order = Window.partitionBy(*by, "r").orderBy("x")
    rows = rows.withColumns({"n": F.row_number().over(order), "next": F.lead("x").over(order)})
    spans = rows.where("n % 2 = 1 and next > x").select(*by, "r", c("x").alias("c0"), c("next").alias("c1"))
    flat = edges.where((c("y0") == c("y1")) & (c("x0") > c("x1")) & (F.floor("y0") + 0.5 == c("y0")))
    side = lambda v: F.floor(c(v) + 0.5).cast("bigint")
    return spans.unionByName(flat.select(*by, F.floor("y0").cast("bigint").alias("r"), side("x1").alias("c0"), side("x0").alias("c1")).where("c1 > c0"))

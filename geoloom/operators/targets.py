"""What each patch is annotated with: detections, instances, classes, change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import burn

c = F.col
SLACK = 1e-9
IGNORE = 255


def detections(patches: DataFrame, shapes: DataFrame, size: int, min_visible: float = 0.3, min_side: float = 2.0) -> DataFrame:
    """patch, feature, class_id, x, y, w, h, area, truncated of the shapes that show enough of themselves in a patch's valid pixels."""
    r4 = lambda v: F.round(v, 4)
    found = burn.seen(patches, shapes, size).withColumn("share", c("seen") / c("area"))
    found = found.withColumns({"x": r4(c("x0") - c("col")), "y": r4(c("y0") - c("row"))})
    found = found.withColumns({"w": r4(r4(c("x1") - c("col")) - c("x")), "h": r4(r4(c("y1") - c("row")) - c("y"))})
    found = found.where((c("share") >= min_visible - SLACK) & (c("h") >= min_side) & (c("w") >= min_side))
    return found.select("patch", "feature", "class_id", "x", "y", "w", "h", r4(c("seen")).alias("area"), (c("share") < 1 - SLACK).alias("truncated"))


def accepts_detections(patches: DataFrame, shapes: DataFrame, found: DataFrame, size: int, least: float) -> DataFrame:
    """patch, covered of the patches whose kept detections cover `least` of it or more, overlaps counted once."""
    return burn.covered(patches, shapes, found, size).where(c("covered") >= least * size * size)


def instances(patches: DataFrame, shapes: DataFrame, size: int, min_visible: float = 0.3, min_area: int = 4, all_touched: bool = False) -> DataFrame:
    """patch, feature, class_id, whole-pixel box x, y, w, h, area in pixels, truncated, counts (run lengths, columns first)."""
    found = burn.own_pixels(patches, shapes, size, all_touched).where((c("share") >= min_visible - SLACK) & (c("area") >= min_area))
    return found.select("patch", "feature", "class_id", "x", "y", "w", "h", "area", (c("share") < 1 - SLACK).alias("truncated"), "counts")


def class_pixels(patches: DataFrame, shapes: DataFrame, size: int, background: int = 0, areas: DataFrame | None = None, ignore: int = IGNORE) -> DataFrame:
    """patch, class_id, pixels of the mask, those of the background and of what is ignored too."""
    found = burn.histogram(patches, shapes, size, areas, ignore)
    return found.withColumn("class_id", F.when(c("class_id") == 0, background).otherwise(c("class_id"))) if background else found


def labelled(counts: DataFrame, size: int, least: float, background: int = 0, ignore: int = IGNORE) -> DataFrame:
    """patch, share of the patches of which at least `least` has a class: a share of all pixels, ignored ones too."""
    found = counts.groupBy("patch").agg((F.sum(F.when(~c("class_id").isin(background, ignore), c("pixels")).otherwise(0)) / float(size * size)).alias("share"))
    return found.where(c("share") >= least)


def patch_classes(counts: DataFrame, min_fraction: float, background: bool = False, ignore: int = IGNORE) -> DataFrame:
    """patch, single, multi: the class with most of the valid pixels (the lowest of equals) and all with enough, ascending.

    counts: patch, class_id, pixels; class 0 is the background, and what is ignored isn't valid. A
    patch without a valid pixel is left out.
    """
    found = counts.where(c("class_id") != ignore).groupBy("patch").agg(F.sum("pixels").alias("valid"), F.sort_array(F.collect_list(F.struct("class_id", "pixels"))).alias("held"))
    enough = F.filter("held", lambda x: (x["class_id"] != 0) & (x["pixels"] > 0) & (x["pixels"] / c("valid") >= min_fraction))
    found = found.withColumn("enough", enough)
    best = F.array_max(F.transform("enough", lambda x: F.struct(x["pixels"].alias("n"), (-x["class_id"]).alias("o"))))
    multi = F.transform("enough", lambda x: x["class_id"])
    named = F.size("enough") > 0
    if not background:
        return found.where(named).select("patch", (-best["o"]).alias("single"), multi.alias("multi"))
    zero = F.lit(0).cast("bigint")
    return found.where(named | (c("valid") > 0)).select("patch", F.when(named, -best["o"]).otherwise(zero).alias("single"), F.when(named, multi).otherwise(F.array(zero)).alias("multi"))

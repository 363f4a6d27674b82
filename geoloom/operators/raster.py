"""Raster operators on sparse pixel rows: (patch keys, r, c, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col


def islands(df: DataFrame, by: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Maximal runs of consecutive values of `at` within `by`: one row with start and end (exclusive)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return df.withColumn("__island", c(at) - rank).groupBy(*by, "__island").agg(F.min(at).alias(start), (F.max(at) + 1).alias(end)).drop("__island")


def runs(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, r, c0, c1: the runs of each row of a mask's true pixels (by, r, c)."""
    return islands(mask, [*by, "r"], "c", "c0", "c1")


def rectangles(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, r0, r1, c0, c1: disjoint boxes that cover the mask, runs that repeat in the next row merged."""
    return islands(runs(mask, by), [*by, "c0", "c1"], "r", "r0", "r1")


def tight_box(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, x, y, w, h of the mask's true pixels, and their number."""
    found = mask.groupBy(*by).agg(F.min("c").alias("x"), F.min("r").alias("y"), F.max("c").alias("x1"), F.max("r").alias("y1"), F.count(F.lit(1)).alias("area"))
    return found.select(*by, "x", "y", (c("x1") - c("x") + 1).alias("w"), (c("y1") - c("y") + 1).alias("h"), "area")


def rle_counts(mask: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """by, counts: lengths of the runs of 0 and 1 in column-major order, 0 first; a last run of 0 is kept."""
    pixels = mask.withColumn("__at", c("c") * height + c("r"))
    spans = islands(pixels, by, "__at", "lo", "hi")
    spans = spans.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    gap = F.transform("spans", lambda s, i: F.array(s["lo"] - F.coalesce(F.get("spans", i - 1)["hi"], F.lit(0)), s["hi"] - s["lo"]))
    rest = F.lit(height * width) - F.element_at("spans", -1)["hi"]
    tail = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    return spans.select(*by, F.concat(F.flatten(gap), tail).cast("array<bigint>").alias("counts"))


def rle_text(counts: Column) -> Column:
    """The compressed string of run lengths: from the fourth on the difference to the second before, in groups of five bits."""
    delta = F.transform(counts, lambda n, i: F.when(i > 2, n - F.get(counts, i - 2)).otherwise(n))

    def letters(value: Column) -> Column:
        # A number ends at the first group whose sign bit agrees with all that is left above it.
        groups = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.struct(F.shiftright(value, 0).alias("v"), k.alias("k")))
        part = lambda k: F.pmod(F.floor(value / F.pow(F.lit(2.0), 5 * k)), F.lit(32)).cast("int")
        left = lambda k: F.floor(value / F.pow(F.lit(2.0), 5 * (k + 1))).cast("bigint")
        last = lambda k: F.when(part(k) >= 16, left(k) == -1).otherwise(left(k) == 0)
        first = F.array_position(F.transform(groups, lambda g: last(g["k"])), F.lit(True)).cast("int") - 1
        return F.array_join(F.transform(F.sequence(F.lit(0), first), lambda k: F.char(part(k) + F.when(k < first, 32).otherwise(0) + 48)), "")

    return F.array_join(F.transform(delta, letters), "")


def histogram(pixels: DataFrame, by: Sequence[str], value: str = "class_id") -> DataFrame:
    return pixels.groupBy(*by, value).agg(F.count(F.lit(1)).alias("pixels"))


def moments(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, count, mean, std (of the population), low, high of the finite values; null where there are none."""
    v = F.when(~F.isnan(value) & (F.abs(c(value)) != float("inf")), c(value))
    return values.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))


def median_frequency_weights(counts: DataFrame, patch: str, value: str = "class_id") -> DataFrame:
    """value, weight: median over classes of frequency over the class's own; frequency is of the pixels of patches that hold the class.

    counts: patch, value, pixels.
    """
    valid = counts.withColumn("all", F.sum("pixels").over(Window.partitionBy(patch))).where(c("pixels") > 0)
    each = valid.groupBy(value).agg((F.sum("pixels") / F.sum("all")).alias("freq"))
    middle = each.agg(F.median("freq").alias("middle"))
    return each.crossJoin(F.broadcast(middle)).select(value, (c("middle") / c("freq")).alias("weight"))


def first_valid(files: DataFrame, by: Sequence[str], order: Sequence[str], value: str, valid: Column) -> DataFrame:
    """by, value: of overlapping files the first, in order, with data at a pixel: an aggregation without a sort."""
    return files.where(valid).groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def nodata(bands: Column, value: float) -> Column:
    """Whether all of an array of bands equal value, or none is a finite number."""
    return F.forall(bands, lambda b: b == value) | F.forall(bands, lambda b: F.isnan(b) | (F.abs(b) == float("inf")))


def reflected(index: Column, size: Column) -> Column:
    """The pixel that stands at a place beyond a row of `size` pixels, mirrored at its ends without repeating them."""
    period = F.greatest(2 * (size - 1), F.lit(1))
    at = F.pmod(index, period)
    return F.least(at, period - at)


def normalised(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std as a float; a deviation of 0 or null counts as 1, not-a-number becomes 0."""
    scale = F.when((std == 0) | std.isNull() | F.isnan(std), 1.0).otherwise(std)
    z = (value - F.coalesce(mean, F.lit(0.0))) / scale
    return F.when(F.isnan(z), 0.0).otherwise(z).cast("float")


def hann(index: Column, size: int) -> Column:
    return F.pow(F.sin(F.pi() * (index + 0.5) / size), F.lit(2.0))


def blended(scores: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """by, score: overlapping predictions (by, r, c within the patch, score) weighted by a window that fades at the edges."""
    w = hann(c("r"), size) * hann(c("c"), size)
    return scores.withColumn("__w", w).groupBy(*by).agg((F.sum(c("__w") * c("score")) / F.greatest(F.sum("__w"), F.lit(1e-12))).alias("score"))


def rescaled(raw: Column, scale: float, offset: float, low: float | None, high: float | None, missing: float | None) -> Column:
    """raw * scale + offset as a float; not-a-number where raw is missing or outside low..high."""
    bad = raw.isNull() | F.isnan(raw)
    for test in ([raw == missing] if missing is not None else []) + ([raw < low] if low is not None else []) + ([raw > high] if high is not None else []):
        bad = bad | test
    return F.when(bad, float("nan")).otherwise(raw * scale + offset).cast("float")

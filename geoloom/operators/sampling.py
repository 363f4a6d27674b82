"""Patch anchors as generated relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
STRATEGIES = ("drop", "shift", "pad")
MAX_ANCHORS = 50_000_000


def checked(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"the edge strategy is one of {', '.join(STRATEGIES)}, not {strategy!r}")
    return strategy


def axis_count(length: Column, patch: Column, stride: Column, strategy: str) -> Column:
    """Anchors on an axis, without making them."""
    checked(strategy)
    fits = length >= patch
    inside = F.when(fits, F.floor((length - patch) / stride) + 1).otherwise(0)
    if strategy == "drop":
        return inside.cast("bigint")
    if strategy == "shift":
        return F.when(fits, inside + ((inside - 1) * stride < length - patch).cast("int")).otherwise(1).cast("bigint")
    return (F.floor((length - 1) / stride) + 1).cast("bigint")


def axis(length: Column, patch: Column, stride: Column, strategy: str) -> Column:
    """Array of the positions on an axis; with shift the last one lies flush with the end."""
    n = axis_count(length, patch, stride, strategy)
    steps = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))), lambda i: i * stride)
    if strategy == "shift":
        steps = F.transform(steps, lambda p: F.greatest(F.lit(0), F.least(p, length - patch)))
    return F.when(n > 0, steps).otherwise(F.array().cast("array<bigint>"))


def grid(rasters: DataFrame, patch: int, stride: int, strategy: str, key: str = "id") -> DataFrame:
    """key, row, col, padded for every anchor of rasters (key, height, width); one with over MAX_ANCHORS raises before."""
    p, s = F.lit(patch).cast("bigint"), F.lit(stride or patch).cast("bigint")
    n = axis_count(c("height"), p, s, strategy) * axis_count(c("width"), p, s, strategy)
    height = F.when(n > MAX_ANCHORS, F.raise_error(F.lit("the grid has too many patches"))).otherwise(c("height"))
    rows = rasters.withColumn("row", F.explode(axis(height, p, s, strategy)))
    return rows.withColumn("col", F.explode(axis(c("width"), p, s, strategy))).select(key, "row", "col", ((c("row") + patch > c("height")) | (c("col") + patch > c("width"))).alias("padded"))


def random_capacity(height: Column, width: Column, patch: Column, strategy: str) -> Column:
    """Places where a patch can lie; one, or none with drop, on an axis that is too short."""
    checked(strategy)
    side = lambda n: F.when(n >= patch, n - patch + 1).otherwise(0 if strategy == "drop" else 1)
    return (side(height) * side(width)).cast("bigint")


def splitmix(state: int) -> tuple[int, int]:
    """The next state and number of the SplitMix64 generator (fixed constants of the published algorithm)."""
    mask = (1 << 64) - 1
    state = (state + 0x9E3779B97F4A7C15) & mask
    z = state
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ (z >> shift)) * factor) & mask
    return state, z ^ (z >> 31)


def random_positions(capacity: int, count: int, seed: int) -> list[int]:
    """A sample without replacement, reproducible by the seed: Floyd's draws, then a Fisher-Yates shuffle."""
    wanted = min(count, capacity)
    if wanted > MAX_ANCHORS:
        raise ValueError("too many random patches")

    def below(n: int) -> int:
        nonlocal seed
        seed, z = splitmix(seed)
        return z * n >> 64

    if wanted == capacity:
        out = list(range(capacity))
    else:
        taken: dict[int, None] = {}
        for top in range(capacity - wanted, capacity):
            draw = below(top + 1)
            taken[top if draw in taken else draw] = None
        out = list(taken)
    for i in range(len(out) - 1, 0, -1):
        j = below(i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def random_grid(rasters: DataFrame, patch: int, count: int, strategy: str = "drop", key: str = "id") -> DataFrame:
    """key, place, row, col: random_positions of each raster (key, height, width, seed), in their order of drawing.

    A raster's positions are made by its task; one with over MAX_ANCHORS raises.
    """
    capacity = random_capacity(c("height"), c("width"), F.lit(patch), strategy)
    across = F.when(c("width") >= patch, c("width") - patch + 1).otherwise(1)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for k, n, wide, seed in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                places = np.array(random_positions(n, count, seed), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(places), batch.schema.field(0).type), pa.array(np.arange(len(places))), pa.array(places // wide), pa.array(places % wide)], [key, "place", "row", "col"])

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, capacity.alias("n"), across.cast("bigint").alias("wide"), c("seed").cast("bigint")).mapInArrow(run, f"{key} {kind}, place long, row long, col long")


def random_anchors(df_range: DataFrame, count: int, seed: int) -> DataFrame:
    """`count` rows of least seeded hash: a distributed sample without replacement, of other draws than random_positions."""
    return df_range.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(count)


def column_clusters(anchors: DataFrame, patch: int) -> DataFrame:
    """anchors with cluster: columns split where the gap is over two patches, numbered from the left."""
    columns = anchors.select("col").distinct()
    step = (c("col") - F.lag("col").over(Window.orderBy("col")) > 2 * patch).cast("int")
    starts = columns.withColumn("step", F.coalesce(step, F.lit(0)))
    numbered = starts.select("col", F.sum("step").over(Window.orderBy("col")).alias("cluster"))
    return anchors.join(numbered, "col")


def chunks(anchors: DataFrame, chunk_rows: int, window: int, patch: int) -> DataFrame:
    """anchors with chunk, a row strip, and window, a range of columns within the strip that fits in memory."""
    strip = F.floor(c("row") / chunk_rows)
    first = F.min("col").over(Window.partitionBy("chunk"))
    return anchors.withColumn("chunk", strip).withColumn("window", F.floor((c("col") - first) / max(1, window - patch)))


def remaining(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What an interrupted run has still to do."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")

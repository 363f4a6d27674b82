"""The reference behaviours that carry state between chunks, as Structured Streaming queries.

All take and give streaming (or batch) DataFrames; sinks and checkpoints are the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def fetch_failures(log: DataFrame, width: str = "10 minutes", late: str = "30 minutes", most: float = 0.05) -> DataFrame:
    """log (ts, source, ok): per source and window the failed and all fetches, and whether the failed are over a share."""
    counts = log.withWatermark("ts", late).groupBy(F.window("ts", width), "source").agg(F.count_if(~c("ok")).alias("failed"), F.count(F.lit(1)).alias("total"))
    return counts.select(c("window.start").alias("start"), "source", "failed", "total", (c("failed") / c("total") > most).alias("stop"))


def unique_anchors(anchors: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """anchors (ts, keys) once each as long as the watermark remembers them."""
    return anchors.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stacks(images: DataFrame, width: str = "30 days", late: str = "1 day") -> DataFrame:
    """images (ts, patch, image): per patch and window the images in order of time."""
    found = images.withWatermark("ts", late).groupBy(F.window("ts", width), "patch").agg(F.sort_array(F.collect_list(F.struct("ts", "image"))).alias("stack"))
    return found.select(c("window.start").alias("start"), "patch", c("stack.image").alias("images"))


def running_moments(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean and deviation so far; for complete or update output."""
    return values.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def fresh_tiles(responses: DataFrame, late: str = "10 minutes") -> DataFrame:
    """responses (ts, tile, body, seconds): the newest of each tile in each window that is still to be kept."""
    kept = responses.where(c("seconds") > 0).withWatermark("ts", late)
    return kept.groupBy(F.window("ts", "1 hour"), "tile").agg(F.max_by("body", "ts").alias("body"), F.max(c("ts") + F.make_dt_interval(secs=c("seconds"))).alias("until")).select("tile", "body", "until")


def append_once(df: DataFrame, epoch: int, path: str) -> None:
    """A foreachBatch sink that can be run again: an epoch's rows replace what an earlier try left."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch:09d}")

"""Imagery by the kind of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.sources import raster, xyz

KINDS = ("geotiff", "xyz")


def imagery(spark: SparkSession, kind: str, path: str, bounds: tuple[float, float, float, float] | None = None, zoom: int | None = None) -> DataFrame:
    """Blocks of pixels of a source: GeoTIFFs by path or glob, or a folder of tiles at a zoom; cut to bounds.

    Bounds are in the GeoTIFFs' own system, or in degrees for tiles, which need them.
    """
    if kind == "geotiff":
        return raster.geotiff_blocks(raster.files(spark, path), bounds=bounds)
    if kind == "xyz":
        if bounds is None or zoom is None:
            raise ValueError("tiles are read at a zoom, within bounds")
        return xyz.blocks(xyz.tiles(spark, path), xyz.region(*bounds, zoom))
    raise ValueError(f"a source is one of {', '.join(KINDS)}, not {kind!r}")

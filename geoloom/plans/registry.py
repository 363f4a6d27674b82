"""All registered queries outside the text package, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.plans import catalog, files, geometry, jobs, masks, more, patches, splitting

MODULES = (geometry, masks, patches, splitting, catalog, more, files, jobs)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: text for m in MODULES for name, (_, text) in m.QUERIES.items() if text}

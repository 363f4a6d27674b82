"""Circles around points and areas in UTM zones, on arrays, against the Column expressions."""

import math

from pyspark.sql import functions as F

from geoloom.functions import tiles as T
from geoloom.functions import utm
from geoloom.operators import features
from geoloom.plans import registry


def test_arrays_equal_expressions(spark):
    places = [(lon, lat) for lon in (-179.99, -3.2, 0.0, 7.5, 179.9) for lat in (-79.9, -0.001, 0.0, 45.3, 83.0)]
    df = spark.createDataFrame([*places, (None, 1.0), (1.0, None)], "lon double, lat double").withColumn("epsg", T.utm_epsg(F.col("lon"), F.col("lat")))
    df = df.withColumn("ring", features.around(F.col("lon"), F.col("lat"), 100.0)[0][0]).withColumn("area", features.zone_area(F.col("ring"), F.col("epsg")))
    rows = df.withColumn("m", utm.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))).withColumn("back", F.transform("ring", lambda p: utm.to_utm(p["x"], p["y"], F.col("epsg")))).collect()
    for r in rows:
        assert len(r.ring) == 32
        if r.epsg is None or r.lon is None or r.lat is None:
            assert r.area is None and all(p.x is None and p.y is None for p in r.ring)
            continue
        for i, p in enumerate(r.back):
            turn = -2 * math.pi * i / 32
            assert math.isclose(p.x, r.m.x + 50 * math.cos(turn), abs_tol=1e-6) and math.isclose(p.y, r.m.y + 50 * math.sin(turn), abs_tol=1e-6)
        assert math.isclose(r.area, 16 * 2500 * math.sin(2 * math.pi / 32), abs_tol=1e-3)


def test_circles_are_spread(spark):
    """The points of one file are dealt over tasks, and no circle is drawn by an expression for each corner."""
    df = registry.QUERIES["l9_point_areas"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "ATANH" not in plan and "ArrowEvalPython" in plan

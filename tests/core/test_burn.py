"""Shapes burned into many patches at a time, against brute force; how the rows of small files are dealt over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import burn, shapes
from geoloom.plans import patches as plans
from geoloom.plans import registry


@pytest.mark.parametrize("work", [1, 5 * 256, 1 << 20])
def test_burned_equals_brute_force(spark, monkeypatch, work):
    """Patches with many shapes, with one and with none, cut at any row of the stream and of its batches; half of them with padding."""
    monkeypatch.setattr(burn, "WORK", work)
    rng = np.random.default_rng(work)
    boxes = [(k, int(rng.integers(1, 5)), int(r), int(r + h), int(x), int(x + w)) for k, (r, x, h, w) in enumerate(zip(rng.integers(0, 60, 90), rng.integers(0, 30, 90), rng.integers(1, 20, 90), rng.integers(1, 20, 90), strict=True))]
    spots = [(k, int(r), int(x)) for k, (r, x) in enumerate(zip(rng.integers(0, 120, 40), rng.integers(0, 50, 40), strict=True))]
    found = plans.boxes_as_shapes(spark.createDataFrame(boxes, "feature long, class_id long, r0 long, r1 long, c0 long, c1 long"))
    windows = spark.createDataFrame(spots, "patch long, row long, col long")
    inside = windows.withColumn("valid", F.when(F.col("patch") % 2 == 0, F.array(F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("r0", 0), ("r1", 50), ("c0", 0), ("c1", 40))]))))
    world = np.full((200, 200), -1)
    for k, _, r0, r1, c0, c1 in boxes:
        world[r0:r1, c0:c1] = k
    classes = np.append([b[1] for b in boxes], 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        pixels = sorted(map(tuple, burn.feature_pixels(inside, found, 16).collect()))
        histogram = sorted(map(tuple, burn.histogram(inside, found, 16).collect()))
        runs = sorted(map(tuple, burn.mask_runs(windows, found, 16).collect()))
        sums = sorted(map(tuple, burn.row_sums(found).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want_pixels, want_histogram, want_runs = [], [], []
    for k, r, x in spots:
        on = world[r : r + 16, x : x + 16]
        valid = np.ones((16, 16), bool) if k % 2 else (np.arange(r, r + 16)[:, None] < 50) & (np.arange(x, x + 16) < 40)
        for values, out in ((on[valid & (on >= 0)], want_pixels), (np.where(valid, classes[on], 255), want_histogram)):
            out += [(k, int(v), int(n)) for v, n in zip(*np.unique(values, return_counts=True), strict=True)]
        for i, line in enumerate(classes[on]):
            turns = [0, *(np.flatnonzero(line[1:] != line[:-1]) + 1).tolist(), 16]
            want_runs += [(k, i, a, b, int(line[a])) for a, b in zip(turns, turns[1:], strict=False) if line[a]]
    assert pixels == sorted(want_pixels) and histogram == sorted(want_histogram) and runs == sorted(want_runs)
    want = {}
    for r, x in zip(*np.nonzero(world >= 0), strict=True):
        n, cols, features = want.get((int(r), int(classes[world[r, x]])), (0, 0, 0))
        want[int(r), int(classes[world[r, x]])] = (n + 1, cols + int(x), features + int(world[r, x]))
    assert sums == sorted((*k, *v) for k, v in want.items())


def test_alike_polygons_equal_single_ones():
    rng = np.random.default_rng(3)
    for n in (2, 3, 4, 6):
        p = rng.integers(0, 4, (400, n, 2)).astype(float)
        p[::50, 0, 0] = np.nan
        p = p[(p[:, 0] != p[:, -1]).any(1)]
        for rings in (p, np.concatenate([p, p[:, :1]], 1)):
            rings = rings[~np.isnan(rings).any((1, 2))] if rings is not p else rings
            for got, ring in zip(shapes.edges_of_alike(rings, (0.5, 0.1, 3, 0.2, -0.7, 1)), rings, strict=True):
                one = shapes.edges_of([ring], (0.5, 0.1, 3, 0.2, -0.7, 1))
                assert np.array_equal(got, one) if len(one) else np.isnan(got).any()


@pytest.mark.parametrize("name", ["v5_burned", "w12_coco_instances", "g8_instance_ids", "g1_mask", "g12_change_areas", "g2_padded_masks"])
def test_boxes_are_dealt_and_nothing_is_broadcast(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    burned = plan.split("MapInArrow")[1:]
    assert len(burned) > 1 and "hashpartitioning(feature" in plan and "hashpartitioning(cr" in plan
    assert not any("BroadcastHashJoin [cr" in part for part in burned)

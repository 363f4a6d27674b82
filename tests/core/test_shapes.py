"""Polygons on pixels: fills, edge walks, clips and burns, against hand counts and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import burn, shapes, targets

CLOCKWISE = [((0, 0), (0, 2), (2, 2), (2, 0)), ((5, 0), (5, 3), (9, 3))]


def edges(*polygons, transform=shapes.IDENTITY):
    parts = [shapes.edges_of([np.array(r, float) for r in rings], shapes.inverse(transform)) for rings in polygons]
    n = [len(p) for p in parts]
    return shapes.Edges(len(parts), np.repeat(np.arange(len(parts)), n), *np.vstack(parts).T)


def mask(rings, size=16, touched=False, transform=shapes.IDENTITY):
    e, zero = edges(rings, transform=transform), np.zeros(1, int)
    out = shapes.filled(e, zero, zero, size)[0]
    return out | shapes.touched(e, zero, zero, size)[0] if touched else out


def closed(ring):
    return np.array([*ring, ring[0]], float)


def test_turns():
    for ring in CLOCKWISE:
        assert shapes.clockwise(closed(ring)) and not shapes.clockwise(closed(ring[::-1]))
    rng = random.Random(1)
    for _ in range(200):  # stars around a centre turn as they are listed
        n = rng.randint(3, 9)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        if max(b - a for a, b in zip(angles, [*angles[1:], angles[0] + 2 * math.pi])) > 3:
            continue
        ring = [(math.cos(a) * 5, math.sin(a) * 5) for a in angles]
        assert not shapes.clockwise(closed(ring)) and shapes.clockwise(closed(ring[::-1]))


# Pixels of shapes on a raster of 128 x 128 with y upwards, without and with all that edges touch.
NORTH_UP = (1.0, 0.0, 0.0, 0.0, -1.0, 128.0)


@pytest.mark.parametrize("ring, inside, touched", [
    ([(0, 0), (1, 0), (1, 1), (0, 1)], 1, 1),
    ([(10, 10), (20, 10), (20, 20), (10, 20)], 100, 100),
    ([(0, 0), (128, 0), (128, 128), (0, 128)], 128 * 128, 128 * 128),
    ([(10.2, 10.2), (10.4, 10.2), (10.4, 10.4), (10.2, 10.4)], 0, 1),
    ([(200, 200), (300, 200), (300, 300)], 0, 0),
])
def test_pixel_counts(ring, inside, touched):
    assert mask([ring], 128, transform=NORTH_UP).sum() == inside
    assert mask([ring], 128, True, NORTH_UP).sum() == touched


def test_centres_on_edges():
    """A centre on a left edge is outside, one on a right edge inside; upper rows in, lower ones by the flat edge's turn."""
    box = mask([[(2.5, 2.5), (6.5, 2.5), (6.5, 6.5), (2.5, 6.5)]])
    assert box[:, 2].sum() == 0 and box[3, 3:7].all() and not box[3, 7]
    assert box[2, 3:7].all() and box[7].sum() == 0
    assert mask([[(2.5, 2.5), (6.5, 2.5), (6.5, 6.5), (2.5, 6.5)][::-1]]).tolist() == box.tolist()


def test_holes_and_even_odd():
    hole = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (6, 3), (6, 6), (3, 6)]]
    assert mask(hole).sum() == 91 and not mask(hole)[3:6, 3:6].any()
    bow = [[(0, 0), (10, 10), (10, 0), (0, 10)]]
    assert 40 <= mask(bow).sum() <= 60


def test_a_vertex_that_is_not_finite_drops_its_polygon():
    assert len(shapes.edges_of([np.array([(0, 0), (1, math.nan), (2, 2)])], shapes.inverse(shapes.IDENTITY))) == 0


def test_walk_against_samples():
    """Every pixel that many points of an edge lie in is touched, and none that no point comes near."""
    rng = random.Random(2)
    for _ in range(60):
        a, b, c = [(rng.uniform(-3, 19), rng.uniform(-3, 19)) for _ in range(3)]
        got = shapes.touched(edges([[a, b, c]]), np.zeros(1, int), np.zeros(1, int), 16)[0]
        near = np.zeros((16, 16), int)
        for (x0, y0), (x1, y1) in ((a, b), (b, c), (c, a)):
            for t in np.linspace(0, 1, 4001):
                x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
                if 0 <= x < 16 and 0 <= y < 16:
                    near[int(y), int(x)] += 1
        assert (got >= (near > 3)).all()
        beside = np.pad(near, 1)
        beside = beside[:-2, 1:-1] + beside[2:, 1:-1] + beside[1:-1, :-2] + beside[1:-1, 2:]
        cut = got & (near == 0)  # corners that an edge cuts off between two points
        assert cut.sum() <= 3 and (beside[cut] > 0).all()


def test_clips_against_pixels():
    """Area and bounds of what is in a frame, on shapes with holes, against a fine raster of the same."""
    rng = random.Random(3)
    for _ in range(30):
        outer = [(8 + r * math.cos(t), 8 + r * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 9)[:-1] for r in [rng.uniform(5, 9)]]
        hole = [(8 + 2 * math.cos(t), 8 + 2 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 7)[:-1]]
        e = edges([outer, hole])
        frame = [np.array([float(v)]) for v in (rng.randint(0, 7), rng.randint(0, 7), rng.randint(9, 16), rng.randint(9, 16))]
        area, bounds = shapes.clipped(e, *frame)
        fine = 32
        big = shapes.filled(edges([[(x * fine, y * fine) for x, y in r] for r in (outer, hole)]), np.zeros(1, int), np.zeros(1, int), 18 * fine)[0]
        x0, y0, x1, y1 = (int(v[0]) * fine for v in frame)
        part = big[y0:y1, x0:x1]
        assert area[0] == pytest.approx(part.sum() / fine**2, abs=0.4)
        rows, cols = np.flatnonzero(part.any(1)) + y0, np.flatnonzero(part.any(0)) + x0
        want = cols[0] / fine, rows[0] / fine, (cols[-1] + 1) / fine, (rows[-1] + 1) / fine
        assert bounds[0] == pytest.approx(want, abs=0.15)


def test_clip_of_a_frame_inside_and_outside():
    e = edges([[(-10, -10), (30, -10), (30, 30), (-10, 30)]], [[(50, 50), (60, 50), (60, 60)]], [[(0, 0), (4, 0), (4, 4), (0, 4)]])
    frame = [np.full(3, float(v)) for v in (0, 0, 16, 16)]
    area, bounds = shapes.clipped(e, *frame)
    assert area.tolist() == [256, 0, 16] and np.isnan(bounds[1]).all()
    assert bounds[0].tolist() == [0, 0, 16, 16] and bounds[2].tolist() == [0, 0, 4, 4]


@pytest.fixture(scope="module")
def scene(spark):
    """Random polygons with holes in order, and overlapping patches of 16 pixels."""
    rng = random.Random(4)
    rows = []
    for i in range(40):
        x, y, r = rng.uniform(0, 80), rng.uniform(0, 80), rng.uniform(2, 20)
        ring = [(x + r * math.cos(t) * rng.uniform(0.6, 1), y + r * math.sin(t) * rng.uniform(0.6, 1)) for t in np.linspace(0, 2 * math.pi, 8)[:-1]]
        hole = [(x + r / 4 * math.cos(t), y + r / 4 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 5)[:-1]]
        rows.append((i, i % 3 + 1, [[ring, hole][: 1 + i % 2]]))
    nested = [(i, k, [[[{"x": a, "y": b} for a, b in ring] for ring in polygon] for polygon in parts]) for i, k, parts in rows]
    features = spark.createDataFrame(nested, f"feature long, class_id long, parts {shapes.PARTS}")
    patches = spark.createDataFrame([(100 * r + c, 10 * r, 12 * c) for r in range(9) for c in range(8)], "patch long, row long, col long")
    whole = np.zeros((2, 120, 120), int)
    whole[1] = -1
    for i, k, parts in rows:
        inside = shapes.filled(edges(parts[0]), np.zeros(1, int), np.zeros(1, int), 120)[0]
        whole[0][inside], whole[1][inside] = k, i
    return rows, shapes.shapes(features), patches, whole


def test_masks_equal_one_large_burn(scene):
    rows, found, patches, whole = scene
    got = {r.patch: np.frombuffer(r.mask, np.uint8).reshape(16, 16) for r in burn.masks(patches, found, 16).collect()}
    places = {r.patch: (r.row, r.col) for r in patches.collect()}
    assert got.keys() == places.keys()
    for p, (r, c) in places.items():
        assert (got[p] == whole[0, r : r + 16, c : c + 16]).all()
    pixels = {(r.patch, r.feature): r.pixels for r in burn.feature_pixels(patches, found, 16).collect()}
    want = {(p, f): int(n) for p, (r, c) in places.items() for f, n in zip(*np.unique(whole[1, r : r + 16, c : c + 16], return_counts=True)) if f >= 0}
    assert pixels == want


def test_validity_and_areas(scene, spark):
    """Pixels that aren't valid, or lie outside the annotated areas, are ignored, and shares are of what is valid."""
    rows, found, patches, whole = scene
    areas = shapes.shapes(spark.createDataFrame([(0, 1, 5, 60, 7, 70)], "feature long, class_id long, r0 long, r1 long, c0 long, c1 long").select("feature", "class_id", shapes.box_parts().alias("parts")))
    valid = burn.within(patches, 50, 1000)
    places = {r.patch: (r.row, r.col) for r in patches.collect()}
    expected = np.full((120, 120), 255)
    expected[5:50, 7:70] = whole[0, 5:50, 7:70]
    got = {r.patch: np.frombuffer(r.mask, np.uint8).reshape(16, 16) for r in burn.masks(valid, found, 16, areas).collect()}
    for p, (r, c) in places.items():
        assert (got[p] == expected[r : r + 16, c : c + 16]).all()
    counts = targets.class_pixels(valid, found, 16, areas=areas)
    classes = {r.patch: (r.single, r.multi) for r in targets.patch_classes(counts, 0.2, background=True).collect()}
    for p, (r, c) in places.items():
        part = expected[r : r + 16, c : c + 16]
        some = part[part < 255]
        if not len(some):
            assert p not in classes
            continue
        enough = [k for k in (1, 2, 3) if (some == k).mean() >= 0.2]
        best = max(enough, key=lambda k: ((some == k).sum(), -k), default=0)
        assert classes[p] == (best, enough or [0])


def test_instances_and_detections_of_polygons(scene):
    rows, found, patches, whole = scene
    places = {r.patch: (r.row, r.col) for r in patches.collect()}
    own = {i: shapes.filled(edges(parts[0]), np.zeros(1, int), np.zeros(1, int), 120)[0] for i, _, parts in rows}
    got = targets.instances(patches, found, 16, min_visible=0.3, min_area=4).collect()
    assert len(got) > 30
    for r in got:
        y, x = places[r.patch]
        part = own[r.feature][y : y + 16, x : x + 16]
        ys, xs = np.nonzero(part)
        assert (r.x, r.y, r.w, r.h, r.area) == (xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, part.sum())
        flat = np.concatenate([np.full(n, k % 2) for k, n in enumerate(r.counts)])
        assert (flat.reshape(16, 16).T == part).all()
    seen = targets.detections(patches, found, 16).collect()
    for r in seen:
        y, x = places[r.patch]
        part = own[r.feature][y : y + 16, x : x + 16]
        assert r.area == pytest.approx(part.sum(), abs=12) and r.x >= 0 and r.x + r.w <= 16 and r.w >= 2
        ys, xs = np.nonzero(part)
        assert (r.x, r.y, r.x + r.w, r.y + r.h) == pytest.approx((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1), abs=1.2)


def test_detections_with_invalid_pixels(spark):
    box = spark.createDataFrame([(1, 1, 2, 10, 3, 11)], "feature long, class_id long, r0 long, r1 long, c0 long, c1 long").select("feature", "class_id", shapes.box_parts().alias("parts"))
    patches = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 0)], "patch long, row long, col long")
    rects = spark.createDataFrame([(1, 0, 16, 0, 7), (2, 0, 4, 0, 16), (2, 8, 16, 0, 16)], "patch long, r0 long, r1 long, c0 long, c1 long")
    got = {r.patch: r for r in targets.detections(burn.with_valid(patches, rects), shapes.shapes(box), 16).collect()}
    assert set(got) == {1, 2}
    assert (got[1].x, got[1].y, got[1].w, got[1].h, got[1].area, got[1].truncated) == (3, 2, 4, 8, 32, True)
    assert (got[2].x, got[2].y, got[2].w, got[2].h, got[2].area) == (3, 2, 8, 8, 32)


def test_change_with_unlabelled_areas(spark):
    make = lambda *boxes: shapes.shapes(spark.createDataFrame(list(boxes), "feature long, class_id long, r0 long, r1 long, c0 long, c1 long").select("feature", "class_id", shapes.box_parts().alias("parts")))
    patch = spark.createDataFrame([(1, 0, 0)], "patch long, row long, col long")
    before, after = make((1, 1, 0, 8, 0, 8)), make((1, 1, 0, 8, 0, 4), (2, 2, 0, 8, 4, 8))
    plain = np.frombuffer(burn.change_masks(patch, before, after, 16).first().mask, np.uint8).reshape(16, 16)
    assert plain[:8, 4:8].all() and plain.sum() == 32
    areas = make((1, 1, 0, 16, 0, 16)), make((1, 1, 0, 4, 0, 16))
    got = np.frombuffer(burn.change_masks(patch, before, after, 16, areas).first().mask, np.uint8).reshape(16, 16)
    assert (got[4:] == 255).all() and (got[:4, 4:8] == 1).all() and not got[:4, :4].any()


def test_empty_sets(spark):
    none = shapes.shapes(spark.createDataFrame([(1, 1, None), (2, 1, [])], f"feature long, class_id long, parts {shapes.PARTS}"))
    patches = spark.createDataFrame([(1, 0, 0)], "patch long, row long, col long")
    assert none.count() == 0
    assert [tuple(r) for r in targets.class_pixels(patches, none, 8).collect()] == [(1, 0, 64)]
    assert targets.detections(patches, none, 8).count() == targets.instances(patches, none, 8).count() == 0
    assert burn.masks(patches.limit(0), none, 8).count() == 0
    assert burn.row_sums(none).agg(F.count("*")).first()[0] == 0

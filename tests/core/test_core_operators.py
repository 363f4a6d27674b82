"""Operators that SQL can't express, and properties, against brute force."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import affine, cleaning, tiles
from geoloom.operators import exports, raster, sampling, spatial, splits


def compressed(counts):
    """The run-length text, written out from its definition."""
    out = []
    for i, n in enumerate(counts):
        x = n - counts[i - 2] if i > 2 else n
        while True:
            part, x = x & 31, x >> 5
            more = x != (-1 if part & 16 else 0)
            out.append(chr(part + (32 if more else 0) + 48))
            if not more:
                break
    return "".join(out)


def test_rle_text_against_its_definition(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([rng.randint(0, 40), rng.randint(0, 70000)]) for _ in range(rng.randint(1, 9))]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, counts array<bigint>")
    got = {r.id: r.text for r in df.select("id", raster.rle_text(F.col("counts")).alias("text")).collect()}
    assert got == {i: compressed(n) for i, n in rows}


@given(st.integers(1, 400), st.integers(0, 500), st.integers(0, 2**64 - 1))
@settings(max_examples=80, deadline=None)
def test_random_positions_are_a_sample(capacity, count, seed):
    found = sampling.random_positions(capacity, count, seed)
    assert len(found) == len(set(found)) == min(count, capacity)
    assert all(0 <= p < capacity for p in found)
    assert found == sampling.random_positions(capacity, count, seed)


def test_random_grid_draws_as_the_generator_does(spark):
    rows = [(1, 70, 80, 5), (2, 64, 64, 9), (3, 10, 90, 1)]
    got = spark.createDataFrame(rows, "id long, height long, width long, seed long")
    found = sampling.random_grid(got, 64, 40).collect()
    for i, h, w, seed in rows:
        n = max(0, h - 63) * max(0, w - 63)
        want = [(k, p // max(1, w - 63), p % max(1, w - 63)) for k, p in enumerate(sampling.random_positions(n, 40, seed))]
        assert sorted((r.place, r.row, r.col) for r in found if r.id == i) == want


def test_splitmix_matches_the_published_sequence():
    state, out = 1234567, []
    for _ in range(3):
        state, z = sampling.splitmix(state)
        out.append(z)
    assert out == [6457827717110365317, 3203168211198807973, 9817491932198370423]


@pytest.mark.parametrize("strategy", sampling.STRATEGIES)
def test_axis_equals_its_count(spark, strategy):
    rows = [(n, p, s) for n in range(1, 40, 3) for p in (1, 5, 16) for s in (1, 4, 16, 20)]
    df = spark.createDataFrame(rows, "n long, p long, s long")
    c = F.col
    for r in df.select("n", "p", "s", sampling.axis_count(c("n"), c("p"), c("s"), strategy).alias("k"), sampling.axis(c("n"), c("p"), c("s"), strategy).alias("a")).collect():
        steps = list(range(0, r.n - r.p + 1, r.s)) if strategy != "pad" else list(range(0, r.n, r.s))
        if strategy == "shift" and (not steps or steps[-1] != r.n - r.p):
            steps.append(max(0, r.n - r.p))
        assert (r.k, r.a) == (len(steps), steps)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(2)
    patches = [(i, rng.randrange(-300, 900), rng.randrange(-300, 900)) for i in range(60)]
    boxes = [(i, r := rng.randrange(-300, 900), r + rng.randint(0, 400), k := rng.randrange(-300, 900), k + rng.randint(0, 400)) for i in range(60)]
    a = spark.createDataFrame(patches, "patch long, row long, col long")
    b = spark.createDataFrame(boxes, "feature long, r0 long, r1 long, c0 long, c1 long")
    want = {(p, f): (max(r, r0), min(r + 64, r1), max(k, c0), min(k + 64, c1)) for p, r, k in patches for f, r0, r1, c0, c1 in boxes if min(r + 64, r1) > max(r, r0) and min(k + 64, c1) > max(k, c0)}
    got = spatial.overlaps(a, b, 64, side=100).collect()
    assert {(x.patch, x.feature): (x.v0, x.v1, x.h0, x.h1) for x in got} == want and len(got) == len(want)


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 3)), max_size=12), st.integers(20, 90))
@settings(max_examples=15, deadline=None, suppress_health_check=[])
def test_shards_never_pass_their_limit(spark, sizes, limit):
    rows = [(f"s{s}", i, n) for i, (n, s) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "split string, ord long, size long")
    held = {}
    for r in sorted(exports.shards(df, limit).collect(), key=lambda r: r.ord):
        held.setdefault((r.split, r.shard), []).append(r.size)
    assert sum(map(len, held.values())) == len(rows)
    assert all(sum(x) <= limit or len(x) == 1 for x in held.values())


def test_spatial_split_has_no_leaks(spark):
    rows = [(i, (i // 20) * 40, (i % 20) * 40) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, row long, col long")
    got = splits.spatial_split(df, "id", 64, 256).collect()
    assert len(got) == 400 and {r.split for r in got} == {"train", "val", "test", "dropped"}
    kept = [r for r in got if r.split != "dropped"]
    for a in kept:
        for b in kept:
            if a.split != b.split:
                assert abs(a.row - b.row) >= 64 or abs(a.col - b.col) >= 64


def test_inverse_is_an_inverse(spark):
    rng = random.Random(3)
    rows = [tuple(rng.uniform(-5, 5) for _ in range(6)) for _ in range(50)] + [(2.0, 0.0, 1.0, 0.0, -2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").select(F.struct("a", "b", "c", "d", "e", "f").alias("t"))
    df = df.select("t", affine.inverse(F.col("t")).alias("i")).withColumn("p", affine.apply(F.col("t"), F.lit(7.0), F.lit(11.0)))
    for r in df.select(affine.apply(F.col("i"), F.col("p.x"), F.col("p.y")).alias("q")).collect():
        assert (r.q.x, r.q.y) == pytest.approx((7, 11), abs=1e-6)


def test_tiles_hold_their_points(spark):
    rng = random.Random(4)
    rows = [(rng.uniform(-180, 180), rng.uniform(-85, 85), rng.randint(0, 20)) for _ in range(300)] + [(200.0, 89.0, 3), (-181.0, -90.0, 3)]
    df = spark.createDataFrame(rows, "lon double, lat double, zoom long").withColumn("t", tiles.tile(F.col("lon"), F.col("lat"), F.col("zoom")))
    df = df.withColumn("b", tiles.tile_bounds(F.col("t.x"), F.col("t.y"), F.col("zoom")))
    for r in df.collect()[:300]:
        assert r.b.west - 1e-9 <= r.lon <= r.b.east + 1e-9 and r.b.south - 1e-9 <= r.lat <= r.b.north + 1e-9
    assert [(r.t.x, r.t.y) for r in df.collect()[300:]] == [(7, 0), (0, 7)]


def test_polygon_fill_against_points_in_polygon(spark):
    """Pixels whose centre is clearly inside are filled, those clearly outside are not."""
    corners = [(10.3, 5.2), (40.7, 9.4), (33.1, 30.8), (22.4, 18.2), (8.9, 28.6)]
    edges = [(1, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
    spans = spatial.filled_spans(spark.createDataFrame(edges, "id long, x0 double, y0 double, x1 double, y1 double"), ["id"]).collect()
    filled = {(r.r, k) for r in spans for k in range(r.c0, r.c1)}
    for r in range(40):
        for k in range(50):
            x, y = k + 0.5, r + 0.5
            crossings = [ax + (y - ay) * (bx - ax) / (by - ay) for _, ax, ay, bx, by in edges if min(ay, by) <= y < max(ay, by)]
            if all(abs(v - x) > 1e-6 for v in crossings):
                assert ((r, k) in filled) == (sum(v < x for v in crossings) % 2 == 1)


def test_more_than_255_classes_is_an_error(spark):
    df = spark.range(300).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("label"))
    with pytest.raises(Exception, match="255 classes"):
        cleaning.class_ids(df, "label").collect()
    assert cleaning.class_ids(df.limit(0), "label").collect() == []


def test_freshness_cases(spark):
    """Published rules: max-age less the age, no-store, an expiry, an invalid one, and the default."""
    cases = [("max-age=3600", None, None, None, 3600), ("max-age=3600", None, None, "600", 3000), ("max-age=600", None, None, "600", None), ("no-cache", None, None, None, None), ("private, max-age=120", None, None, None, 120), ("max-age=60", 1e9, None, None, 60), (None, 1500.0, 1000.0, None, 500), (None, None, None, None, 7 * 86400), ("max-age=999999999", None, None, None, 365 * 86400)]
    df = spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(cases)], "i int, control string, expires double, date double, age string")
    got = df.select("i", cleaning.freshness(F.col("control"), F.col("expires"), F.col("date"), F.col("age"), F.lit(0.0)).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [x[4] for x in cases]


def test_moments_of_nothing_are_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, float("inf")), (2, 1.0), (2, 3.0), (2, None)], "k int, v double")
    got = {r.k: r for r in raster.moments(df, ["k"], "v").collect()}
    assert got[1]["count"] == 0 and got[1].mean is None
    assert (got[2]["count"], got[2].mean, got[2]["std"]) == (2, 2.0, 1.0)
    assert math.isclose(got[2].high, 3.0)

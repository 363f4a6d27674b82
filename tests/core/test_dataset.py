"""Datasets, features, tiles and streams: what SQL doesn't check."""

import datetime
import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import alignment, catalogue, dataset, features, fetching
from geoloom.sources import opening, png, raster, tiff, xyz
from geoloom.streaming import jobs


def test_policies():
    assert [fetching.after_failure(p) for p in ("strict", "lenient", "ignore")] == ["error", "missing", "black"]
    with pytest.raises(ValueError, match="policy"):
        fetching.after_failure("never")


def test_tag_selectors():
    assert catalogue.tag_selector({"highway": "*", "name": 'a"b'}) == '["highway"]["name"="a\\"b"]'
    assert catalogue.tag_selector({"building": ["house", "a.b"]}) == '["building"~"^(house|a\\\\.b)$"]'


def test_label_fields_never_group_long_columns(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("few"), F.col("id").cast("string").alias("many"))
    got = catalogue.label_fields(df, ["few", "many"]).collect()
    assert {r.field for r in got} == {"few"} and [r.n for r in got if r["rank"] == 1] == [667]
    assert catalogue.label_fields(df, ["many"]).count() == 0


def test_guards(spark):
    df = spark.createDataFrame([(1, 0, 10, 0, 10)], "feature long, r0 long, r1 long, c0 long, c1 long")
    assert not features.misses(df, 5, 5) and features.misses(df.withColumn("r0", F.lit(90)).withColumn("r1", F.lit(99)), 50, 50)
    assert features.require_some(df) is df
    with pytest.raises(ValueError, match="skipped"):
        features.require_some(df.limit(0))
    with pytest.raises(ValueError, match="EPSG"):
        features.to_degrees(F.col("parts"), 2154)


def test_zones_round_trip(spark):
    at = "array<array<array<struct<x:double,y:double>>>>"
    df = spark.createDataFrame([(1, [[[{"x": 448251.8, "y": 5411932.7}]]])], f"id int, parts {at}")
    p = df.select(features.to_degrees(F.col("parts"), 32631)[0][0][0].alias("p")).first().p
    assert (p.x, p.y) == pytest.approx((2.2945, 48.8582), abs=1e-3)


def test_composed_grids():
    assert alignment.composed((1, 0, 10, 0, -1, 20), (2, 0, 0, 0, -2, 40)) == pytest.approx((0.5, 0, 5, 0, 0.5, 10))
    with pytest.raises(ValueError, match="inverse"):
        alignment.composed((1, 0, 0, 0, 1, 0), (0, 0, 0, 0, 1, 0))


def test_resume_and_complete(spark):
    planned = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "row long, col long")
    done = planned.where("row = 0")
    assert dataset.resumed(planned, None).count() == 3
    assert [tuple(r) for r in dataset.resumed(planned, done, {"a": 1}, {"a": 1}).collect()] == [(1, 0)]
    with pytest.raises(ValueError, match="other settings: a, b"):
        dataset.resumed(planned, done, {"a": 1}, {"a": 2, "b": None, "c": 3} | {"c": None} | {"b": 4})
    with pytest.raises(ValueError, match="1 patches are missing"):
        dataset.require_complete(planned, done)
    assert dataset.require_complete(planned, planned) is planned


def test_records_of_splits():
    assert dataset.left_out('{"dropped": 4}') == 4
    assert [dataset.left_out(x) for x in (None, "", "[]", '{"dropped": "x"}', '{"dropped": -3}')] == [0] * 5


def test_documents():
    assert dataset.dataset_yaml({4: "a: b", 2: "c"}, False) == 'train: train.txt\nval: val.txt\nnames:\n  0: "c"\n  1: "a: b"\n'
    text = dataset.training_config("/d", "segmentation", {"x": 3}, [0.5], [0.25], ["train"])
    assert "    num_classes: 4\n" in text and text.count("_split:") == 1 and "means: [0.5]" in text
    assert "PixelwiseRegression" in dataset.training_config("/d", "regression", {}, [], [], [])
    for bad in (("detection", "tif"), ("segmentation", "npy")):
        with pytest.raises(ValueError):
            dataset.training_config("/d", bad[0], {}, [], [], [], suffix=bad[1])


def test_tasks(spark):
    patches = spark.createDataFrame([(1, 0, 0)], "patch long, row long, col long")
    assert dataset.target(spark, "image-only", patches, None, 8) is patches
    for task, shapes in (("regression", patches), ("other", patches), ("detection", None)):
        with pytest.raises(ValueError):
            dataset.target(spark, task, patches, shapes, 8)


def test_export_is_whole_or_not_there(spark, tmp_path):
    df = spark.range(20).select("id", F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    path = f"file://{tmp_path}/set"
    dataset.exported(df, path)
    dataset.exported(df.where("id < 10"), path)
    got = spark.read.parquet(path)
    assert got.count() == 10 and not (tmp_path / "set.part").exists()
    with pytest.raises(Exception, match="broken"):
        dataset.exported(df.withColumn("id", F.raise_error(F.lit("broken"))), path)
    assert spark.read.parquet(path).count() == 10


def test_digest_problems(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "name string, sha256 string")
    listed = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "name string, sha256 string")
    assert sorted(map(tuple, dataset.digest_problems(files, listed).collect())) == [("b", "differs"), ("c", "missing"), ("d", "unlisted")]


def test_tile_folder(spark, tmp_path):
    """A region of a folder of tiles: its size and place, windows over missing and black tiles, what to fetch again."""
    part = xyz.region(10.0, 50.0, 11.0, 50.5, 9)
    assert (part.x0, part.x1, part.y0, part.y1) == (270, 271, 172, 173) and (part.width, part.height) == (512, 512)
    rng = np.random.default_rng(1)
    whole = np.zeros((512, 512, 3), np.uint8)
    for x in (270, 271):
        for y in (172, 173):
            if (x, y) == (271, 173):
                continue
            image = rng.integers(0, 3, (256, 256, 3), np.uint8)
            (tmp_path / f"9/{x}").mkdir(parents=True, exist_ok=True)
            (tmp_path / f"9/{x}/{y}.png").write_bytes(png.encode(image))
            whole[(y - 172) * 256 : (y - 171) * 256, (x - 270) * 256 : (x - 269) * 256] = image
    (tmp_path / "9/270/999.png").write_bytes(b"far away")
    (tmp_path / "notes.txt").write_bytes(b"no tile")
    found = xyz.tiles(spark, f"file://{tmp_path}")
    pixels, valid = xyz.read_window(found, part, 200, 400, 100, 300)
    assert (pixels == whole[200:400, 100:300]).all() and (valid == whole[200:400, 100:300].any(2)).all()
    assert [tuple(r) for r in xyz.missing(found, part).collect()] == [(271, 173)]
    a, _, x, _, e, y = part.transform
    assert (x + 512 * a, y + 512 * e) == pytest.approx((x + 2 * 78271.516964, y - 2 * 78271.516964), abs=1e-3)
    with pytest.raises(ValueError):
        xyz.region(3, 4, 3, 5, 9)


def test_patches_of_several_files_padding_and_stacks(spark, tmp_path):
    """Two overlapping GeoTIFFs: the first by name with data wins; patches beyond the edge are empty or mirrored."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 99, (2, 20, 24)).astype(np.uint8)
    a[3:6, 4:9] = 0
    for name, image in (("a", a), ("b", b)):
        (tmp_path / f"{name}.tif").write_bytes(tiff.write(image, (1.0, 0.0, 0.0, 0.0, -1.0, 20.0), 3857, nodata=0))
    blocks = opening.imagery(spark, "geotiff", f"file://{tmp_path}/*.tif").withColumn("file", F.regexp_extract("file", r"(\w)\.tif$", 1))
    patches = spark.createDataFrame([(1, 2, 3), (2, 14, 18)], "patch long, row long, col long")
    whole = np.where(a > 0, a, b)
    got = {r.patch: r for r in raster.extracted(blocks, patches, 10).collect()}
    image = lambda r: np.frombuffer(r.pixels, np.uint8).reshape(10, 10)
    assert (image(got[1]) == whole[2:12, 3:13]).all() and got[1].n_valid == 100
    assert (image(got[2])[:6, :6] == whole[14:, 18:]).all() and got[2].n_valid == 36 and image(got[2]).sum() == whole[14:, 18:].sum()
    mirrored = {r.patch: r for r in raster.extracted(blocks, patches, 10, reflect=True).collect()}
    assert (image(mirrored[2]) == np.pad(whole[14:, 18:], ((0, 4), (0, 4)), mode="reflect")).all() and mirrored[2].n_valid == 36
    part = opening.imagery(spark, "geotiff", f"file://{tmp_path}/a.tif", bounds=(5.0, 3.0, 9.5, 7.0)).first()
    assert (part.row, part.height, part.col, part.width) == (13, 4, 5, 5)
    with pytest.raises(ValueError, match="zoom"):
        opening.imagery(spark, "xyz", "x")
    with pytest.raises(ValueError, match="one of"):
        opening.imagery(spark, "ftp", "x")
    times = raster.extracted(blocks, patches, 10).select("*", F.lit(2).alias("time")).unionByName(raster.extracted(blocks, patches.withColumn("row", F.lit(0).cast("long")), 10).select("*", F.lit(1).alias("time")))
    stack = np.load(io.BytesIO({r.patch: r.content for r in raster.stacked(times).collect()}[1]))
    assert stack.shape == (2, 1, 10, 10) and (stack[1, 0] == whole[2:12, 3:13]).all() and (stack[0, 0] == whole[:10, 3:13]).all()


def test_npy_lengths(spark, tmp_path):
    for i, a in enumerate((np.zeros((3, 4, 5), np.float32), np.zeros(7, np.uint8), np.array(2.5))):
        np.save(tmp_path / f"{i}.npy", a)
    assert raster.cut_short(raster.files(spark, f"file://{tmp_path}")).count() == 0
    (tmp_path / "1.npy").write_bytes((tmp_path / "1.npy").read_bytes()[:-1])
    assert [r.problem for r in raster.cut_short(raster.files(spark, f"file://{tmp_path}")).collect()] == ["is cut short"]


def stream(spark, folder, schema, rows):
    """Each list of rows is one micro-batch."""
    for i, batch in enumerate(rows):
        path = folder / f"{i:03d}.json"
        path.write_text("".join(json.dumps(dict(zip((f.split()[0] for f in schema.split(", ")), r))) + "\n" for r in batch))
        os.utime(path, (1.7e9 + 60 * i,) * 2)  # files are read in order of time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def drained(df, name, mode, folder):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def at(minute):
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_failures_as_a_stream_drop_late_rows(spark, tmp_path):
    """A window closes when the watermark passes it; a row that comes after that changes nothing."""
    (tmp_path / "in").mkdir()
    batches = [[(at(1), "a", True), (at(2), "a", False)], [(at(60), "a", True)], [(at(61), "a", True)], [(at(3), "a", False)], [(at(120), "a", True)], [(at(240), "a", True)]]
    log = stream(spark, tmp_path / "in", "ts timestamp, source string, ok boolean", batches)
    got = drained(jobs.fetch_failures(log), "failures", "append", tmp_path)
    first = [r for r in got if r.start == datetime.datetime(2024, 1, 1)]
    assert [(r.failed, r.total, r.stop) for r in first] == [(1, 2, True)]


def test_anchors_as_a_stream_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[(at(1), 0, 0), (at(1), 0, 1), (at(2), 0, 0)], [(at(3), 0, 1), (at(4), 5, 5)]]
    anchors = stream(spark, tmp_path / "in", "ts timestamp, row long, col long", batches)
    got = drained(jobs.unique_anchors(anchors, ["row", "col"]), "anchors_once", "append", tmp_path)
    assert sorted((r.row, r.col) for r in got) == [(0, 0), (0, 1), (5, 5)]


def test_tiles_and_stacks_as_streams(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name / "in").mkdir(parents=True)
    tiles = stream(spark, tmp_path / "a/in", "ts timestamp, tile string, body string, seconds double", [[(at(1), "t", "old", 600.0), (at(5), "t", "new", 60.0), (at(5), "u", "x", 0.0)], [(at(300), "v", "y", 5.0)], [(at(900), "w", "z", 5.0)]])
    got = drained(jobs.fresh_tiles(tiles), "fresh", "append", tmp_path / "a")
    assert [(r.tile, r.body) for r in got if r.tile in "tu"] == [("t", "new")]
    images = stream(spark, tmp_path / "b/in", "ts timestamp, patch long, image string", [[(at(10), 1, "b"), (at(5), 1, "a")], [(at(99999), 1, "far")], [(at(199999), 1, "farther")]])
    stacks = drained(jobs.stacks(images), "stacked", "append", tmp_path / "b")
    assert ["a", "b"] in [list(r.images) for r in stacks]


def test_epochs_are_written_once(spark, tmp_path):
    df = spark.range(3)
    for rows in (df, df.limit(2)):
        jobs.append_once(rows, 7, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2

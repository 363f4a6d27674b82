"""A dataset as a table of patches: what is planned, kept, done, described, checked and exported.

A manifest is a table (patch, row, col, chunk, files, ...); splits are (patch, split).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.cleaning import human_bytes, size_category
from geoloom.operators import burn, raster, splits

c = F.col
# Fixed values of the planner: over so many tiles, bytes or patches a job is large; bytes of an encoded image per raw one.
LARGE_TILES, LARGE_BYTES, LARGE_PATCHES = 20_000, 5 << 30, 1_000_000
PNG_RATIO, JPG_RATIO, TIF_FLOAT_RATIO = 0.7, 0.15, 0.8
SPLIT_NAMES = ("train", "val", "test")
TASKS = ("segmentation", "detection", "instance", "classification", "change", "regression", "image-only")


# --- sampling and resuming


def by_strip(positions: DataFrame, rows: int, order: Column) -> DataFrame:
    """positions with strip (of `rows` rows) and place, their order of drawing within it."""
    found = positions.withColumn("strip", F.floor(c("row") / rows))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("strip").orderBy(order)).cast("bigint"))


def short_of(found: Column, wanted: Column) -> Column:
    """Why fewer random patches were drawn than wanted, else null."""
    text = F.concat(F.lit("only "), found.cast("string"), F.lit(" of "), wanted.cast("string"), F.lit(" random patches have a place"))
    return F.when(found < wanted, text)


def completed(manifest: DataFrame) -> DataFrame:
    """The positions (row, col) that are done, once each."""
    return manifest.select("row", "col").distinct()


def before_break(manifest: DataFrame, broken: Column) -> DataFrame:
    """The patches of chunks before the first that has a broken patch."""
    first = manifest.where(broken).agg(F.min("chunk").alias("__broken"))
    return manifest.crossJoin(F.broadcast(first)).where("__broken is null or chunk < __broken").drop("__broken")  # one row


def empty_ratio(pixels: DataFrame, by: Sequence[str], empty: Column) -> DataFrame:
    """by, empty_ratio: the share of a patch's pixels that are empty."""
    return pixels.groupBy(*by).agg(F.avg(empty.cast("double")).alias("empty_ratio"))


def keep_reason(empty: Column, labelled: Column, most_empty: float, least_labelled: float) -> Column:
    """'no imagery', 'too empty', 'too few labels' or 'kept': the first rule that applies."""
    return F.when(empty >= 1, "no imagery").when(empty > most_empty, "too empty").when(labelled < least_labelled, "too few labels").otherwise("kept")


def mismatches(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, fields: the names of settings of two runs that differ, nulls equal; equal runs are left out."""
    names = F.array_compact(F.array(*[F.when(~c(f"a.{f}").eqNullSafe(c(f"b.{f}")), F.lit(f)) for f in fields]))
    return old.alias("a").join(new.alias("b"), key).select(key, F.array_join(names, ",").alias("fields")).where("fields <> ''")


def resumed(planned: DataFrame, manifest: DataFrame | None, old: Mapping | None = None, new: Mapping | None = None) -> DataFrame:
    """What is still to be done of planned positions (row, col): all without a manifest; an error if the run's settings differ."""
    if manifest is None:
        return planned
    differ = sorted(k for k in {*(old or {}), *(new or {})} if (old or {}).get(k) != (new or {}).get(k))
    if differ:
        raise ValueError(f"the dataset was begun with other settings: {', '.join(differ)}")
    return planned.join(completed(manifest), ["row", "col"], "left_anti")


def require_complete(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest, or an error if a planned position is missing."""
    left = resumed(planned, manifest).count()
    if left:
        raise ValueError(f"the dataset is not complete: {left} patches are missing")
    return manifest


def upgraded(entries: DataFrame) -> DataFrame:
    """Entries of old manifests (filename, mask_filename, row, col, padded, strip_index, per_class_pixel_counts, empty_ratio) as new ones."""
    files = F.map_filter(F.create_map(F.lit("image"), c("filename"), F.lit("mask"), c("mask_filename")), lambda _, v: v.isNotNull())
    counts = c("per_class_pixel_counts").cast("map<string,bigint>")
    summary = F.struct(c("empty_ratio").cast("double").alias("empty_ratio"), counts.alias("class_pixels"))
    return entries.select("row", "col", F.coalesce("padded", F.lit(False)).alias("padded"), c("strip_index").alias("chunk"), files.alias("files"), summary.alias("summary"))


# --- planning


def image_bytes(size: Column, bands: Column, width: Column, image_format: str) -> Column:
    """Estimated bytes of a patch: size pixels square, `width` bytes a value."""
    raw = (bands * size * size * width).cast("double")
    if image_format == "npy":
        return raw
    if image_format == "tif":
        return raw * F.when(width == 1, PNG_RATIO).otherwise(TIF_FLOAT_RATIO)
    if image_format not in ("jpg", "png"):
        raise ValueError(f"no estimate for {image_format}")
    return 3.0 * size * size * (JPG_RATIO if image_format == "jpg" else PNG_RATIO)


def is_large(tiles: Column, size: Column, patches: Column) -> Column:
    return (F.coalesce(tiles, F.lit(0)) > LARGE_TILES) | (size > LARGE_BYTES) | (patches > LARGE_PATCHES)


def large_reason(tiles: Column, size: Column, patches: Column) -> Column:
    """What makes a job large, null if nothing does."""
    parts = F.array_compact(F.array(
        F.when(F.coalesce(tiles, F.lit(0)) > LARGE_TILES, F.concat(tiles.cast("string"), F.lit(" tiles"))),
        F.when(size > LARGE_BYTES, human_bytes(size)),
        F.when(patches > LARGE_PATCHES, F.concat(patches.cast("string"), F.lit(" patches"))),
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))


def label_summary(features: DataFrame, name: str, inside: Column) -> DataFrame:
    """name, features, in_region: features of each class, and those that meet the region."""
    return features.groupBy(name).agg(F.count(F.lit(1)).alias("features"), F.count_if(inside).alias("in_region"))


# --- statistics and splits


def valid_pixels(pixels: DataFrame, by: Sequence[str], bands: Sequence[Column], nodata: float | None = None, black_is_empty: bool = False) -> DataFrame:
    """by, valid: pixels with a finite band that are not all NoData and, for tiles, not black."""
    values = F.array(*bands)
    gone = raster.nodata(values, nodata) if nodata is not None else F.forall(values, lambda b: F.isnan(b) | (F.abs(b) == float("inf")))
    if black_is_empty:
        gone = gone | F.forall(values, lambda b: b == 0)
    return pixels.groupBy(*by).agg(F.count_if(~gone).alias("valid"))


def statistics(values: DataFrame, counts: DataFrame, split_of: DataFrame, split: str = "train", band: str = "band", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Moments by band, and pixels, patches, frequency and weight by class, of the patches of one split ('all': every one).

    values: patch, band, value; counts: patch, class_id, pixels.
    """
    if split != "all":
        some = split_of.where(c("split") == split).select("patch")
        values, counts = values.join(some, "patch", "left_semi"), counts.join(some, "patch", "left_semi")
    balance = counts.groupBy("class_id").agg(F.sum("pixels").alias("pixels"), F.count(F.lit(1)).alias("patches"))
    total = balance.agg(F.sum("pixels").alias("__all"))
    weights = raster.median_frequency_weights(counts, "patch")
    classes = balance.crossJoin(F.broadcast(total)).join(weights, "class_id", "left")  # one row
    return raster.moments(values, [band], value), classes.select("class_id", "pixels", "patches", (c("pixels") / c("__all")).alias("frequency"), "weight")


def resplit(manifest: DataFrame, strategy: str, patch: int, **options) -> DataFrame:
    """patch, split of a dataset that exists; positions and sizes come from its manifest."""
    if strategy == "spatial":
        return splits.spatial_split(manifest.select("patch", "row", "col"), "patch", patch, **options).select("patch", "split")
    if strategy == "stratified":
        return splits.stratified_split(manifest.select("patch", "stratum"), "patch", ["stratum"], **options).select("patch", "split")
    if strategy == "random":
        return splits.random_split(manifest.select("patch"), "patch", **options)
    raise ValueError(f"no strategy {strategy!r}")


def left_out(record: str | None) -> int:
    """Patches that a split's record (JSON) says it dropped; 0 where it says nothing."""
    try:
        return max(int(json.loads(record or "").get("dropped", 0)), 0)
    except (ValueError, TypeError, AttributeError):
        return 0


def patch_geometry(manifest: DataFrame) -> DataFrame:
    """patch_size, stride: the size that entries record, and the least step between neighbours' rows or columns (the size alone)."""
    steps = []
    for axis in ("row", "col"):
        places = manifest.select(c(axis).alias("at")).distinct().withColumn("range", F.floor(c("at") / 65536))
        step = c("at") - F.lag("at").over(Window.partitionBy("range").orderBy("at"))
        steps.append(places.select(step.alias("step")).where("step > 0"))
    least = steps[0].unionByName(steps[1]).agg(F.min("step").alias("step"))
    size = manifest.agg(F.max("size").alias("patch_size"))
    return size.crossJoin(least).select("patch_size", F.coalesce("step", "patch_size").alias("stride"))  # a row each


# --- files and documents


def patch_name(patch: Column, suffix: str, folder: str = "Images") -> Column:
    return F.concat(F.lit(f"{folder}/patch_"), F.lpad(patch.cast("string"), 7, "0"), F.lit(f".{suffix}"))


def source_names(patches: DataFrame, sources: Sequence[str], suffix: str) -> DataFrame:
    """patch, source, name: the first source's files under Images, further ones under folders of their names."""
    each = F.array(*[F.struct(F.lit(s).alias("source"), patch_name(c("patch"), suffix, "Images" if i == 0 else f"Images_{s}").alias("name")) for i, s in enumerate(sources)])
    return patches.select("patch", F.inline(each))


def change_names(patches: DataFrame, suffix: str, mask_suffix: str = "png") -> DataFrame:
    """patch, before, after, label: the names of a change dataset's three files."""
    return patches.select("patch", patch_name(c("patch"), suffix, "A").alias("before"), patch_name(c("patch"), suffix, "B").alias("after"), patch_name(c("patch"), mask_suffix, "label").alias("label"))


def split_lists(split_of: DataFrame, name: str = "name") -> DataFrame:
    """split, name: the lines of each split's list, those of no split left out. Files are written by split, in order of names."""
    return split_of.where(c("split").isin(*SPLIT_NAMES)).select("split", name)


def refreshed(manifest: DataFrame, split_of: DataFrame, name: str = "name") -> DataFrame:
    """manifest with the split of each patch ('' for none), for the outputs that depend on it."""
    return manifest.drop("split").join(split_of.select(name, "split"), name, "left").withColumn("split", F.coalesce(F.when(c("split").isin(*SPLIT_NAMES), c("split")), F.lit("")))


def detection_files(objects: DataFrame, split_of: DataFrame, names: Mapping[int, str], width: int, height: int) -> DataFrame:
    """name, content of a detection dataset: a label file a patch, patches without an object an empty one.

    objects: patch, feature, class_id, x, y, w, h; names of all classes, numbered from 0 in order of their ids.
    """
    from geoloom.operators.exports import yolo_line

    index = {k: i for i, k in enumerate(sorted(names))}
    number = F.create_map(*[F.lit(v) for item in index.items() for v in item])[c("class_id")]
    line = yolo_line(number, c("x"), c("y"), c("w"), c("h"), width, height)
    lines = objects.select("patch", "feature", line.alias("line")).groupBy("patch").agg(F.sort_array(F.collect_list(F.struct("feature", "line")))["line"].alias("lines"))
    found = split_of.select("patch").join(lines, "patch", "left")
    return found.select(patch_name(c("patch"), "txt", "labels").alias("name"), F.coalesce(F.array_join("lines", "\n"), F.lit("")).alias("content"))


def dataset_yaml(names: Mapping[int, str], has_test: bool) -> str:
    """The file that a detection trainer reads: image lists by split and class names by number."""
    lines = ["train: train.txt", "val: val.txt", *(["test: test.txt"] if has_test else []), "names:"]
    return "\n".join(lines + [f"  {i}: {json.dumps(names[k], ensure_ascii=False)}" for i, k in enumerate(sorted(names))]) + "\n"


def training_config(root: str, task: str, classes: Mapping[str, int], means: Sequence[float], stds: Sequence[float], split_names: Sequence[str], suffix: str = "tif", batch_size: int = 8, num_workers: int = 4) -> str:
    """The data section of a training configuration for segmentation or regression on GeoTIFF or PNG patches."""
    if task not in ("segmentation", "regression"):
        raise ValueError(f"the configuration is for segmentation and regression, not {task}")
    if suffix == "npy":
        raise ValueError("patches must be images: write them as tif")
    kind = "GenericNonGeoPixelwiseRegressionDataModule" if task == "regression" else "GenericNonGeoSegmentationDataModule"
    lines = ["data:", f"  class_path: terratorch.datamodules.{kind}", "  init_args:", f"    batch_size: {batch_size}", f"    num_workers: {num_workers}"]
    if task == "segmentation":
        lines.append(f"    num_classes: {max([0, *classes.values(), 1]) + 1}")
    for split in SPLIT_NAMES:
        lines += [f"    {split}_data_root: {json.dumps(f'{root}/Images')}", f"    {split}_label_data_root: {json.dumps(f'{root}/Masks')}"]
        lines += [f"    {split}_split: {json.dumps(f'{root}/splits/{split}.txt')}"] if split in split_names else []
    lines += [f'    img_grep: "*.{suffix}"', f'    label_grep: "*.{suffix}"', f"    means: {json.dumps([round(m, 6) for m in means])}", f"    stds: {json.dumps([round(s, 6) for s in stds])}"]
    return "\n".join(lines) + "\n"


def card(name: str, manifest: DataFrame, split_of: DataFrame, classes: Mapping[str, int], bands: DataFrame | None = None, ignore: int | None = None) -> str:
    """A description of a dataset: size category, classes, splits, and moments by band (band, mean, std)."""
    patches = manifest.count()
    size = manifest.sparkSession.range(1).select(size_category(F.lit(patches))).first()[0]
    out = ["---", "license: other", f"pretty_name: {json.dumps(name, ensure_ascii=False)}", "tags:", "- remote-sensing", "size_categories:", f"- {size}", "---", f"# {name}", "", f"{patches:,} patches.", "", "## Classes", "", "| ID | Class |", "| --- | --- |"]
    out += [f"| {k} | {label} |" for label, k in sorted(classes.items(), key=lambda x: x[1])]
    out += [f"| {ignore} | no imagery or no label |"] if ignore is not None else []
    counts = dict(split_of.where(c("split").isin(*SPLIT_NAMES)).groupBy("split").count().collect())
    out += ["", "## Splits", "", "| Split | Patches |", "| --- | --- |", *[f"| {s} | {counts[s]:,} |" for s in SPLIT_NAMES if s in counts]]
    if bands is not None:
        out += ["", "## Normalisation", "", "| Band | Mean | Std |", "| --- | --- | --- |"]
        out += [f"| {r['band']} | {r['mean']:.6g} | {r['std']:.6g} |" for r in bands.orderBy("band").collect() if r["mean"] is not None]
    return "\n".join(out) + "\n"


def manifest_lines(manifest: DataFrame, fields: Sequence[str]) -> DataFrame:
    """patch, line: an entry a patch as JSON."""
    return manifest.select("patch", F.to_json(F.struct(*fields)).alias("line"))


def checksum_lines(files: DataFrame, name: Column, content: str, key: str) -> DataFrame:
    """key, line: digest and name, as checksum programs read them."""
    return files.select(key, F.concat(F.sha2(c(content).cast("binary"), 256), F.lit("  "), name).alias("line"))


def listed_problems(listed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """key, problem: listed files that are missing, and files that aren't listed."""
    missing = listed.join(there, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(there.join(listed, key, "left_anti").select(key, F.lit("unlisted").alias("problem")))


def digest_problems(files: DataFrame, listed: DataFrame) -> DataFrame:
    """name, problem of files (name, sha256) against a list of digests."""
    both = listed.withColumnRenamed("sha256", "wanted").join(files, "name", "full")
    problem = F.when(c("sha256").isNull(), "missing").when(c("wanted").isNull(), "unlisted").when(c("sha256") != c("wanted"), "differs")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def exported(df: DataFrame, path: str, split: str = "split") -> None:
    """Write df by split under path, all of it or nothing: into a folder beside it, which then takes its name."""
    spark, part = df.sparkSession, f"{path.rstrip('/')}.part"
    df.write.mode("overwrite").partitionBy(split).parquet(part)
    jvm = spark._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (part, path))
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{part} can't be moved to {path}")


def inference_stride(size: Column, overlap: Column) -> Column:
    """The step between overlapping windows, 1 at least."""
    return F.greatest(F.lit(1), F.bround(size * (1 - overlap)).cast("bigint"))


def target(spark: SparkSession, task: str, patches: DataFrame, shapes: DataFrame | None, size: int, **options) -> DataFrame:
    """What a task annotates each patch with; image-only patches as they are."""
    from geoloom.operators import targets

    if task == "image-only":
        return patches
    if task not in TASKS:
        raise ValueError(f"the task is one of {', '.join(TASKS)}, not {task!r}")
    if shapes is None:
        raise ValueError(f"{task} needs labels")
    if task == "segmentation":
        return burn.masks(patches, shapes, size, **options)
    if task == "detection":
        return targets.detections(patches, shapes, size, **options)
    if task == "instance":
        return targets.instances(patches, shapes, size, **options)
    if task == "classification":
        least = options.pop("min_fraction", 0.0)
        return targets.patch_classes(targets.class_pixels(patches, shapes, size, **options), least, background=True)
    if task == "change":
        return burn.change_masks(patches, shapes, options.pop("after"), size, **options)
    raise ValueError("regression patches are rows of values: rescaled and padded, not drawn")

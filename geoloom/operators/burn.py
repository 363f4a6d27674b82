"""Shapes burned into patches: arrays of one patch at a time, later features on top, as a stream per partition.

Patches are rows (patch, row, col) of windows of `size` pixels, and may have `valid`, the disjoint
pixel boxes (r0, r1, c0, c1) of the raster that hold imagery; null or no such column: all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.shapes import EDGES, Edges, clipped, filled, touched
from geoloom.operators.spatial import CELL, cells

c = F.col
RECTS = "array<struct<r0:bigint,r1:bigint,c0:bigint,c1:bigint>>"
#: Pixels of all windows that are filled at a time.
WORK = 1 << 20
#: Pixels along the side of a tile that is burned by itself: a fill makes all of its window.
TILE = 64
#: Sets of windows whose rows are given together.
CHUNKS = 16


def within(patches: DataFrame, height: int, width: int) -> DataFrame:
    """patches with valid: what lies on a raster of height x width; the rest is padding."""
    return patches.withColumn("valid", F.array(F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("r0", 0), ("r1", height), ("c0", 0), ("c1", width))])))


def with_valid(patches: DataFrame, rects: DataFrame) -> DataFrame:
    """patches with valid: their disjoint boxes (patch, r0, r1, c0, c1), none where rects has none."""
    held = rects.groupBy("patch").agg(F.collect_list(F.struct(*[c(n).cast("bigint").alias(n) for n in ("r0", "r1", "c0", "c1")])).alias("valid"))
    return patches.join(held, "patch", "left").withColumn("valid", F.coalesce("valid", F.array().cast(RECTS)))


def pairs(patches: DataFrame, shapes: DataFrame, size: int, side: int = CELL) -> DataFrame:
    """Every patch with every shape whose pixel box reaches into it; of the edges those that matter there.

    As in overlaps(), a pair that meets in several cells is kept in the first. A copy of a shape for a
    cell keeps the edges on the cell's rows and those of a patch below, and none to the right of them.
    Both are shuffled at any size: files say too little of the size of edges to broadcast them, and what
    joins a broadcast stays in the tasks of the scan.
    """
    a = patches.select("*", F.inline(cells(c("row"), c("row") + size, c("col"), c("col") + size, side)))
    b = shapes.select("*", F.inline(cells(c("r0"), c("r1"), c("c0"), c("c1"), side)))
    top, right = c("cr") * side, (c("cc") + 1) * side + size
    matters = lambda e: (F.greatest(e["y0"], e["y1"]) >= top) & (F.least(e["y0"], e["y1"]) <= top + side + size) & (F.least(e["x0"], e["x1"]) <= right)
    meet = a.join(b.withColumn("edges", F.filter("edges", matters)).hint("merge"), ["cr", "cc"])
    share = (c("row") < c("r1")) & (c("row") + size > c("r0")) & (c("col") < c("c1")) & (c("col") + size > c("c0"))
    first = (c("cr") == F.floor(F.greatest("row", "r0") / side)) & (c("cc") == F.floor(F.greatest("col", "c0") / side))
    return meet.where(share & first).drop("cr", "cc", "r0", "r1", "c0", "c1")


def tiles(shapes: DataFrame, side: int = TILE) -> DataFrame:
    """patch, row, col of the tiles of a raster that shapes reach into."""
    found = shapes.select(F.inline(cells(c("r0"), c("r1"), c("c0"), c("c1"), side))).distinct()
    return found.select((c("cr") * (1 << 31) + c("cc")).alias("patch"), (c("cr") * side).alias("row"), (c("cc") * side).alias("col"))


class Canvas:
    """Some patches: patch, row, col [n], and in each layer the number of the shape on top of each pixel (0: none).

    class_id and feature are those of the numbers (0 and -1 where there is none); valid is null where all pixels are.
    """

    def __init__(self, patch: np.ndarray, row: np.ndarray, col: np.ndarray, top: np.ndarray, class_id: np.ndarray, feature: np.ndarray, valid: np.ndarray | None):
        self.patch, self.row, self.col, self.top, self.class_id, self.feature, self.valid = patch, row, col, top, class_id, feature, valid
        self.held: dict = {}

    def classes(self, layer: int) -> np.ndarray:
        if layer not in self.held:
            self.held[layer] = self.class_id[self.top[layer]]
        return self.held[layer]

    def part(self, low: int, high: int | None) -> Canvas:
        some = slice(low, high)
        return Canvas(self.patch[some], self.row[some], self.col[some], self.top[:, some], self.class_id, self.feature, None if self.valid is None else self.valid[some])

    def compact(self) -> Canvas:
        """The same with the numbers that are to be seen alone."""
        seen = np.zeros(len(self.class_id), bool)
        seen[self.top] = seen[0] = True
        return Canvas(self.patch, self.row, self.col, (np.cumsum(seen) - 1).astype(self.top.dtype)[self.top], self.class_id[seen], self.feature[seen], self.valid)


def valid_mask(rects: list | None, row: int, col: int, size: int) -> np.ndarray:
    out = np.full((size, size), rects is None)
    for r in rects or ():
        out[max(0, r["r0"] - row) : max(0, r["r1"] - row), max(0, r["c0"] - col) : max(0, r["c1"] - col)] = True
    return out


def over_patches(patches: DataFrame, layers: list[DataFrame], size: int, body: Callable[[Canvas], tuple], schema: str, all_touched: bool = False, kept: DataFrame | None = None) -> DataFrame:
    """patch and the columns of schema: the rows that body gives for patches burned with each layer's shapes in order.

    Rows of a patch meet in one task, sorted, and pass through it as a stream, some at a time: a patch with however
    many shapes holds its own arrays only. body returns the place of each row's patch in the canvas and a column
    (array or list) for each of schema. Of the first layer only the pairs in kept (patch, feature) are burned, if it is given.
    """
    has_valid = "valid" in patches.columns
    blank = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = patches.select("patch", c("row").cast("bigint").alias("row"), c("col").cast("bigint").alias("col"), c("valid") if has_valid else blank("valid", RECTS), F.lit(-1).alias("layer"), blank("feature", "bigint"), blank("class_id", "bigint"), blank("edges", EDGES))
    plain = patches.select("patch", c("row").cast("bigint").alias("row"), c("col").cast("bigint").alias("col"))
    for k, shapes in enumerate(layers):
        found = pairs(plain, shapes, size)
        found = found.join(kept.select("patch", "feature").distinct(), ["patch", "feature"], "left_semi") if kept is not None and not k else found
        rows = rows.unionByName(found.select("patch", "row", "col", blank("valid", RECTS), F.lit(k).alias("layer"), "feature", "class_id", "edges"))
    n_layers, names = len(layers), [x.split()[0] for x in schema.split(", ")]

    step = max(1, WORK // (size * size))
    number = np.int16 if step + n_layers * size * size + 1 < 1 << 15 else np.int64

    def burned(batch: pa.RecordBatch, last: Canvas | None) -> Canvas:
        """last, which the first rows may go on with, and the patches of a batch behind it."""
        patch, row, col, layer = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
        new = np.append(last is None or patch[0] != last.patch[0], patch[1:] != patch[:-1])
        first, k = np.flatnonzero(new), int(last is not None)
        n = k + len(first)
        top = np.zeros((n_layers, n, size, size), number)
        before = (np.zeros(1, np.int64), np.full(1, -1)) if last is None else (last.class_id, last.feature)
        rects = batch.column(3).take(pa.array(first)).to_pylist() if batch.column(3).null_count < batch.num_rows else [None] * len(first)
        valid = None
        if any(x is not None for x in rects) or (k and last.valid is not None):
            valid = np.ones((n, size, size), bool)
            for i, x in enumerate(rects):
                valid[k + i] = valid_mask(x, row[first[i]], col[first[i]], size)
        if k:
            top[:, 0] = last.top[:, 0]
            if last.valid is not None:
                valid[0] = last.valid[0]
        own = np.flatnonzero(layer >= 0)
        if len(own):
            some = batch.take(pa.array(own))
            edges = Edges.of(some.column(7))
            region = filled(edges, row[own], col[own], size)
            if all_touched:
                region |= touched(edges, row[own], col[own], size)
            level = region * np.arange(len(before[0]), len(before[0]) + len(own)).astype(number)[:, None, None]
            place = (np.cumsum(new) + k - 1)[own]
            for i, at in enumerate(zip(layer[own].tolist(), place.tolist(), strict=True)):
                on = top[at]
                np.maximum(on, level[i], out=on)  # later numbers are higher
            before = tuple(np.append(x, some.column(j).fill_null(0).to_numpy()) for x, j in zip(before, (6, 5), strict=True))
        head = (lambda v, f: v[first] if last is None else np.append(f, v[first]))
        return Canvas(head(patch, k and last.patch), head(row, k and last.row), head(col, k and last.col), top, *before, valid)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, []

        def out() -> pa.RecordBatch:
            columns = [x for x in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if isinstance(x[0], np.ndarray) else pa.array([v for part in x for v in part]) for x in columns], ["patch", *names])

        def add(p: Canvas) -> None:
            which, *columns = body(p)
            if len(which):
                done.append((p.patch[which], *columns))

        for whole in found:
            for start in range(0, whole.num_rows, step):
                now = burned(whole.slice(start, step), last)
                if len(now.patch) > 1:
                    add(now.part(0, -1))
                last = now.part(-1, None).compact()
                if len(done) >= CHUNKS:
                    yield out()
            if done:
                yield out()
        if last is not None:
            add(last)
            if done:
                yield out()

    return rows.repartition("patch").sortWithinPartitions("patch", "layer", "feature").mapInArrow(run, f"patch long, {schema}")


def histogram(patches: DataFrame, shapes: DataFrame, size: int, areas: DataFrame | None = None, ignore: int = 255, all_touched: bool = False) -> DataFrame:
    """patch, class_id, pixels of each patch's mask: 0 without a shape, `ignore` where it is not valid or outside areas."""

    body = lambda p: counts(p.class_id, p.top[0], there(p), ignore)
    return over_patches(patches, [shapes, *([areas] if areas is not None else [])], size, body, "class_id long, pixels long", all_touched)


def counts(values: np.ndarray, top: np.ndarray, some: np.ndarray | None, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, value and pixels of each patch's values of the numbers in top [n, size, size]; `other` where it isn't in some."""
    known, code = np.unique(np.append(values, other), return_inverse=True)
    at = code[top] if some is None else np.where(some, code[top], code[-1])
    n, k = len(top), len(known)
    found = np.bincount((at.reshape(n, -1) + np.arange(n)[:, None] * k).ravel(), minlength=n * k).reshape(n, k)
    which, v = np.nonzero(found)
    return which, known[v], found[which, v]


def there(p: Canvas) -> np.ndarray | None:
    """Pixels that aren't ignored, null for all: with a second layer, of areas, those that it covers."""
    if len(p.top) == 1:
        return p.valid
    return p.top[1] > 0 if p.valid is None else p.valid & (p.top[1] > 0)


def mask_of(p: Canvas, ignore: int) -> np.ndarray:
    some = there(p)
    return p.classes(0) if some is None else np.where(some, p.classes(0), ignore)


def runs_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, row, first and last column (exclusive) of the maximal runs of one value in the rows of m [n, size, size]."""
    new = np.ones(m.shape, bool)
    new[:, :, 1:] = m[:, :, 1:] != m[:, :, :-1]
    which, r, first = np.nonzero(new)
    last = np.append(first[1:], 0)
    return which, r, first, np.where(last == 0, m.shape[2], last)


def byte_masks(m: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    return np.arange(len(m)), [x.tobytes() for x in m.astype(np.uint8)]


def masks(patches: DataFrame, shapes: DataFrame, size: int, areas: DataFrame | None = None, ignore: int = 255, all_touched: bool = False) -> DataFrame:
    """patch, mask: size * size bytes of classes in rows."""
    body = lambda p: byte_masks(mask_of(p, ignore))
    return over_patches(patches, [shapes, *([areas] if areas is not None else [])], size, body, "mask binary", all_touched)


def mask_runs(patches: DataFrame, shapes: DataFrame, size: int, areas: DataFrame | None = None, ignore: int = 255, all_touched: bool = False) -> DataFrame:
    """patch, r, c0, c1, class_id: maximal runs of one class in the rows of each mask, those of class 0 left out."""

    def body(p: Canvas) -> tuple:
        m = mask_of(p, ignore)
        which, r, first, last = runs_of(m)
        value = m[which, r, first]
        some = value != 0
        return which[some], r[some], first[some], last[some], value[some]

    return over_patches(patches, [shapes, *([areas] if areas is not None else [])], size, body, "r long, c0 long, c1 long, class_id long", all_touched)


def feature_pixels(patches: DataFrame, shapes: DataFrame, size: int, all_touched: bool = False) -> DataFrame:
    """patch, feature, pixels: what is to be seen of each feature in the patch's id mask."""

    def body(p: Canvas) -> tuple:
        which, values, n = counts(p.feature, p.top[0], p.valid, -1)
        return tuple(x[values >= 0] for x in (which, values, n))

    return over_patches(patches, [shapes], size, body, "feature long, pixels long", all_touched)


def row_sums(shapes: DataFrame, all_touched: bool = False) -> DataFrame:
    """r, class_id, pixels, cols, features: of each row of the burned raster the pixels of a class and the sums of their columns and features."""

    def body(p: Canvas) -> tuple:
        which, r, first, last = runs_of(p.top[0])
        number = p.top[0][which, r, first]
        some = np.flatnonzero(number)
        which, n, first, number = which[some], (last - first)[some], first[some], number[some]
        rows, classes = p.row[which] + r[some], p.class_id[number]
        cols, features = n * (p.col[which] + first) + n * (n - 1) // 2, n * p.feature[number]
        order = np.lexsort((classes, rows))
        rows, classes = rows[order], classes[order]
        start = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (classes[1:] != classes[:-1]))) if len(rows) else np.zeros(0, int)
        add = lambda x: np.add.reduceat(x[order], start) if len(start) else x
        return which[order][start], rows[start], classes[start], add(n), add(cols), add(features)

    found = over_patches(tiles(shapes), [shapes], TILE, body, "r long, class_id long, pixels long, cols long, features long", all_touched)
    return found.groupBy("r", "class_id").agg(*[F.sum(n).alias(n) for n in ("pixels", "cols", "features")])


def covered(patches: DataFrame, shapes: DataFrame, kept: DataFrame, size: int, all_touched: bool = False) -> DataFrame:
    """patch, covered: valid pixels under the shapes of the pairs in kept, each once."""
    body = lambda p: (np.arange(len(p.patch)), ((p.top[0] > 0) if p.valid is None else (p.top[0] > 0) & p.valid).sum((1, 2)))
    return over_patches(patches, [shapes], size, body, "covered long", all_touched, kept)


def change(patches: DataFrame, before: DataFrame, after: DataFrame, size: int, body: Callable[[Canvas, np.ndarray, np.ndarray], tuple], schema: str, areas: tuple[DataFrame, DataFrame] | None = None, all_touched: bool = False) -> DataFrame:
    """Rows of body(canvas, changed, known) for patches: pixels whose classes differ, among those that both sets label.

    A set labels all of the raster, or what its own areas cover; pixels that aren't valid are not known.
    """

    everywhere = areas is None

    def both(p: Canvas) -> tuple:
        known = np.ones(p.top.shape[1:], bool) if p.valid is None else p.valid
        known = known if everywhere else known & (p.top[2] > 0) & (p.top[3] > 0)
        return body(p, known & (p.classes(0) != p.classes(1)), known)

    return over_patches(patches, [before, after, *(areas or ())], size, both, schema, all_touched)


def change_masks(patches: DataFrame, before: DataFrame, after: DataFrame, size: int, areas: tuple[DataFrame, DataFrame] | None = None, value: int = 1, ignore: int = 255, all_touched: bool = False) -> DataFrame:
    """patch, mask: bytes of value where the sets differ, 0 where not, ignore where either has no labels."""
    body = lambda p, changed, known: byte_masks(np.where(known, changed * value, ignore))
    return change(patches, before, after, size, body, "mask binary", areas, all_touched)


def seen(patches: DataFrame, shapes: DataFrame, size: int) -> DataFrame:
    """patch, row, col, feature, class_id, area (of the whole shape), seen (of what is valid in the patch), and its bounds x0, y0, x1, y1."""
    has_valid = "valid" in patches.columns
    window = [("__r0", c("row")), ("__r1", c("row") + size), ("__c0", c("col")), ("__c1", c("col") + size)]
    found = pairs(patches, shapes, size)
    if has_valid:
        whole = F.array(F.struct(*[v.cast("bigint").alias(n[2:]) for n, v in window]))
        found = found.withColumn("__rect", F.explode(F.coalesce("valid", whole)))
        window = [(n, (F.greatest if n[-1] == "0" else F.least)(v, c("__rect")[n[2:]])) for n, v in window]
    found = found.select("patch", "row", "col", "feature", "class_id", "area", *[v.cast("double").alias(n) for n, v in window], "edges").where("__r1 > __r0 and __c1 > __c0")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            r0, r1, c0, c1 = (batch.column(k).to_numpy() for k in range(6, 10))
            area, bounds = clipped(Edges.of(batch.column(10)), c0, r0, c1, r1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(area), *[pa.array(bounds[:, k]) for k in range(4)]], ["patch", "row", "col", "feature", "class_id", "area", "seen", "x0", "y0", "x1", "y1"])

    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    head = ", ".join(f"{n} {kinds[n]}" for n in ("patch", "row", "col", "feature", "class_id", "area"))
    out = found.mapInArrow(run, f"{head}, seen double, x0 double, y0 double, x1 double, y1 double").where("seen > 0 and not isnan(x0)")
    if not has_valid:
        return out
    return out.groupBy("patch", "row", "col", "feature", "class_id", "area").agg(F.sum("seen").alias("seen"), *[f(n).alias(n) for n, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])


def own_pixels(patches: DataFrame, shapes: DataFrame, size: int, all_touched: bool = False) -> DataFrame:
    """patch, feature, class_id, share (seen of the whole), x, y, w, h and area in pixels, counts (run lengths): each shape burned by itself."""
    has_valid = "valid" in patches.columns
    found = pairs(patches, shapes, size).select("patch", "row", "col", "feature", "class_id", "area", c("valid") if has_valid else F.lit(None).cast(RECTS).alias("valid"), "edges")
    names = ["patch", "feature", "class_id", "share", "x", "y", "w", "h", "area", "counts"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, WORK // (size * size))
        for whole in rows:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                row, col = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
                edges = Edges.of(batch.column(7))
                region = filled(edges, row, col, size)
                if all_touched:
                    region |= touched(edges, row, col, size)
                share, _ = clipped(edges, col, row, col + size, row + size, False)
                if has_valid:
                    for i, rects in enumerate(batch.column(6).to_pylist()):
                        region[i] &= valid_mask(rects, row[i], col[i], size)
                        share[i] = share[i] if rects is None else part_of(edges.part(i, i + 1), rects, row[i], col[i], size)
                n = region.sum((1, 2))
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                region, n = region[some], n[some]
                rows_, cols = region.any(2), region.any(1)
                y, x = rows_.argmax(1), cols.argmax(1)
                h, w = size - rows_[:, ::-1].argmax(1) - y, size - cols[:, ::-1].argmax(1) - x
                with np.errstate(divide="ignore", invalid="ignore"):
                    share = share[some] / batch.column(5).to_numpy()[some]
                keep = lambda k: batch.column(k).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([keep(0), keep(3), keep(4), pa.array(share), *[pa.array(v.astype(np.int64)) for v in (x, y, w, h, n)], run_lengths(region)], names)

    kind = {f.name: f.dataType.simpleString() for f in found.schema}
    return found.mapInArrow(run, f"patch {kind['patch']}, feature long, class_id long, share double, x long, y long, w long, h long, area long, counts array<long>")


def part_of(edges: Edges, rects: list, row: int, col: int, size: int) -> float:
    """Area of one shape within the valid boxes of its window."""
    total = 0.0
    for r in rects:
        box = [np.array([float(v)]) for v in (max(col, r["c0"]), max(row, r["r0"]), min(col + size, r["c1"]), min(row + size, r["r1"]))]
        if box[2] > box[0] and box[3] > box[1]:
            total += float(clipped(edges, *box)[0][0])
    return total


def run_lengths(masks: np.ndarray) -> pa.ListArray:
    """Lengths of the runs of 0 and 1 of each mask [n, size, size] in column-major order, 0 first."""
    n = len(masks)
    flat = masks.transpose(0, 2, 1).reshape(n, -1)
    which, at = np.nonzero(flat[:, 1:] != flat[:, :-1])
    all_, full = np.arange(n), np.flatnonzero(flat[:, 0])
    own = np.concatenate([all_, full, which, all_])
    ends = np.concatenate([np.zeros(n + len(full), np.int64), at + 1, np.full(n, flat.shape[1])])
    order = np.lexsort((ends, own))
    own, ends = own[order], ends[order]
    starts = np.append(0, np.cumsum(np.bincount(own, minlength=n) - 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.diff(ends)[own[1:] == own[:-1]]))

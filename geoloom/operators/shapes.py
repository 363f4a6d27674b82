"""Polygons on a pixel grid: edges, fills, edge walks and clips, for all polygons of a batch at once.

A feature's parts are polygons of rings of (x, y), the first ring the outside, the others holes. Its
shape is the list of its edges in pixel coordinates (column, row), every ring closed and turned
clockwise, with a weight of 1 for outsides and -1 for holes, and the pixel box around them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
PARTS = "array<array<array<struct<x:double,y:double>>>>"
EDGES = "array<struct<x0:double,y0:double,x1:double,y1:double,w:double>>"
SHAPE = f"feature long, class_id long, r0 long, r1 long, c0 long, c1 long, area double, edges {EDGES}"
_FIELDS = ("x0", "y0", "x1", "y1", "w")
# Fixed values of the pixel rules: how near to its pivot a vertex makes the turn of a ring unclear, how
# near to a pixel boundary an edge lies on it, and how near to an axis it runs along one column or row.
UNCLEAR, ALIGNED, ALONG = 1e-5, 1e-4, 0.01


def box_parts(r0: str = "r0", r1: str = "r1", c0: str = "c0", c1: str = "c1"):
    """A half-open pixel box as parts."""
    at = lambda x, y: F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    return F.array(F.array(F.array(at(c0, r0), at(c1, r0), at(c1, r1), at(c0, r1))))


def clockwise(ring: np.ndarray) -> bool:
    """Whether a closed ring [n + 1, 2] turns clockwise with y upwards, told at its lowest, then rightmost vertex.

    Where a neighbour is that vertex, or it appears twice, the sign of the whole area tells.
    """
    p = ring[:-1]
    at = int(np.lexsort((-p[:, 0], p[:, 1]))[0]) if len(p) else 0
    if len(p) > 2:
        before, after = p[at - 1] - p[at], p[(at + 1) % len(p)] - p[at]
        again = int((p == p[at]).all(1).sum()) > 1
        turn = after[0] * before[1] - before[0] * after[1]
        if turn and not again and all(np.abs(d).max() >= UNCLEAR for d in (before, after)):
            return bool(turn < 0)
    x, y = ring[:, 0], ring[:, 1]
    return bool((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() < 0)


def edges_of_alike(p: np.ndarray, to_pixels: Sequence[float]) -> np.ndarray | None:
    """edges_of() of m polygons of one ring [m, n, 2] each: [m, edges, 5], not a number where there are none; null if rings differ in being closed."""
    if p.shape[1] < 2:
        return np.full((len(p), 0, 5), np.nan)
    open_ = (p[:, 0] != p[:, -1]).any(1)
    if open_.any():
        if not open_.all():
            return None
        p = np.concatenate([p, p[:, :1]], 1)
    x, y = p[:, :, 0], p[:, :, 1]
    turned = (x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(1) < 0
    q, each = p[:, :-1], np.arange(len(p))
    n = q.shape[1]
    if n > 2:
        low = q[:, :, 1] == q[:, :, 1].min(1)[:, None]
        right = np.where(low, q[:, :, 0], -np.inf)
        least = low & (right == right.max(1)[:, None])
        at = least.argmax(1)
        before, after = q[each, at - 1] - q[each, at], q[each, (at + 1) % n] - q[each, at]
        turn = after[:, 0] * before[:, 1] - before[:, 0] * after[:, 1]
        clear = (turn != 0) & (least.sum(1) == 1) & (np.abs(before).max(1) >= UNCLEAR) & (np.abs(after).max(1) >= UNCLEAR)
        turned = np.where(clear, turn < 0, turned)
    p = np.where(turned[:, None, None], p, p[:, ::-1])
    a, b, x, d, e, y = to_pixels
    q = np.stack([a * p[:, :, 0] + b * p[:, :, 1] + x, d * p[:, :, 0] + e * p[:, :, 1] + y], 2)
    q[~np.isfinite(q).all((1, 2))] = np.nan
    return np.concatenate([q[:, :-1], q[:, 1:], np.ones((len(q), n, 1))], 2)


def inverse(transform: Sequence[float]) -> tuple[float, ...]:
    a, b, x, d, e, y = transform
    det = a * e - b * d
    if not det or not np.isfinite(det):
        raise ValueError("the transform has no inverse")
    ia, ib, id_, ie = e / det, -b / det, -d / det, a / det
    return ia, ib, -(ia * x + ib * y), id_, ie, -(id_ * x + ie * y)


def edges_of(rings: list[np.ndarray], to_pixels: Sequence[float]) -> np.ndarray:
    """Edges [n, 5] of one polygon; none if a vertex isn't finite or no ring has two places."""
    a, b, x, d, e, y = to_pixels
    out = []
    for k, p in enumerate(rings):
        if len(p) < 2:
            continue
        if (p[0] != p[-1]).any():
            p = np.vstack([p, p[:1]])
        if not clockwise(p):
            p = p[::-1]
        q = np.column_stack([a * p[:, 0] + b * p[:, 1] + x, d * p[:, 0] + e * p[:, 1] + y])
        if not np.isfinite(q).all():
            return np.zeros((0, 5))
        out.append(np.hstack([q[:-1], q[1:], np.full((len(q) - 1, 1), -1.0 if k else 1.0)]))
    return np.vstack(out) if out else np.zeros((0, 5))


def shapes(features: DataFrame, transform: Sequence[float] = IDENTITY) -> DataFrame:
    """SHAPE of features (feature, class_id, parts in world coordinates); transform maps (column, row) to the world.

    Null or empty parts, and polygons with a vertex that isn't finite, have no edges; a feature without edges is left out.
    """
    to_pixels = inverse(transform)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            polygons = batch.column(2)
            rings = polygons.flatten()
            places = rings.flatten()
            points = places.flatten()
            xy = np.column_stack([points.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]).astype(np.float64)
            sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (polygons, rings)]
            of_ring = np.append(0, np.cumsum(places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            alike = None
            if batch.num_rows and all((n == 1).all() for n in sizes) and (np.diff(of_ring) == of_ring[1]).all():
                alike = edges_of_alike(xy.reshape(batch.num_rows, int(of_ring[1]), 2), to_pixels)
            if alike is not None:
                kept = np.flatnonzero(~np.isnan(alike).any((1, 2))) if alike.shape[1] else ()
                edges = alike[kept] if len(kept) else ()
            else:
                of_feature, of_polygon = (np.append(0, np.cumsum(n)) for n in sizes)
                kept, edges = [], []
                for i in range(batch.num_rows):
                    some = [edges_of([xy[of_ring[k] : of_ring[k + 1]] for k in range(of_polygon[j], of_polygon[j + 1])], to_pixels) for j in range(of_feature[i], of_feature[i + 1])]
                    some = np.vstack(some) if some else np.zeros((0, 5))
                    if len(some):
                        kept.append(i)
                        edges.append(some)
            if not len(kept):
                continue
            n = np.array([len(x) for x in edges])
            all_ = np.vstack(edges) if alike is None else edges.reshape(-1, 5)
            low, high = (f(all_[:, :2], all_[:, 2:4]) for f in (np.minimum, np.maximum))
            starts = np.cumsum(n) - n
            first, last = np.floor(np.minimum.reduceat(low, starts)).astype(np.int64), np.ceil(np.maximum.reduceat(high, starts)).astype(np.int64)
            last = np.maximum(last, first + 1)  # flat shapes touch a row or column
            area = np.abs(np.add.reduceat(all_[:, 4] * (all_[:, 0] * all_[:, 3] - all_[:, 2] * all_[:, 1]) / 2, starts))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(kept)) for k in (0, 1)], pa.array(first[:, 1]), pa.array(last[:, 1]), pa.array(first[:, 0]), pa.array(last[:, 0]), pa.array(area), edge_lists(all_, n)], ["feature", "class_id", "r0", "r1", "c0", "c1", "area", "edges"])

    rows = features.select(c("feature").cast("long").alias("feature"), c("class_id").cast("long").alias("class_id"), c("parts").cast(PARTS).alias("parts"))
    return rows.mapInArrow(run, SHAPE)


def edge_lists(edges: np.ndarray, n: np.ndarray) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(edges[:, i]) for i in range(5)], _FIELDS)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), values)


@dataclass
class Edges:
    """The edges of n shapes: shape (its number), x0, y0, x1, y1, w."""

    n: int
    shape: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    w: np.ndarray

    @staticmethod
    def of(column: pa.ListArray) -> Edges:
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten()
        return Edges(len(lengths), np.repeat(np.arange(len(lengths)), lengths), *(values.field(i).to_numpy(zero_copy_only=False) for i in range(5)))

    def part(self, low: int, high: int) -> Edges:
        a, b = np.searchsorted(self.shape, (low, high))
        return Edges(high - low, self.shape[a:b] - low, *(getattr(self, f)[a:b] for f in _FIELDS))


def _each(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. last (inclusive) the number of each one's range and its values, one after another."""
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def filled(edges: Edges, row: np.ndarray, col: np.ndarray, size: int) -> np.ndarray:
    """Even-odd fill of n shapes in their windows (row, col, size pixels square): bool [n, size, size].

    A row is sampled at its centre; an edge counts on rows from its upper end to before its lower end;
    crossings are rounded to the nearest pixel edge, and a pixel is inside if an odd number lies at or
    before it. A flat edge on a row of centres that runs from right to left fills its own pixels.
    """
    down = edges.y1 > edges.y0
    top, bottom = np.where(down, edges.y0, edges.y1), np.where(down, edges.y1, edges.y0)
    x_top, x_bottom = np.where(down, edges.x0, edges.x1), np.where(down, edges.x1, edges.x0)
    start = row[edges.shape]
    first = np.maximum(np.ceil(top - 0.5).clip(-(2.0**62), 2.0**62).astype(np.int64), start)
    last = np.minimum(np.ceil(bottom - 0.5).clip(-(2.0**62), 2.0**62).astype(np.int64) - 1, start + size - 1)
    i, r = _each(first, np.where(top < bottom, last, first - 1))
    x = (r + 0.5 - top[i]) * (x_bottom[i] - x_top[i]) / (bottom[i] - top[i]) + x_top[i]
    own = edges.shape[i]
    k = (np.floor(x + 0.5) - col[own]).clip(0, size).astype(np.int64)
    toggles = np.zeros((edges.n, size, size + 1), np.uint8)  # what overflows is even
    np.add.at(toggles.reshape(-1), (own * size + r - row[own]) * (size + 1) + k, np.uint8(1))
    inside = (np.cumsum(toggles, axis=2, dtype=np.uint8) & 1).view(bool)[:, :, :size]
    for j in np.flatnonzero((edges.y0 == edges.y1) & (edges.x0 > edges.x1) & (np.floor(edges.y0) + 0.5 == edges.y0)):
        s = edges.shape[j]
        r = int(np.floor(edges.y0[j])) - row[s]
        if 0 <= r < size:
            low, high = ((np.floor(v + 0.5) - col[s]).clip(0, size).astype(int) for v in (edges.x1[j], edges.x0[j]))
            inside[s, r, low:high] = True
    return inside


def touched(edges: Edges, row: np.ndarray, col: np.ndarray, size: int) -> np.ndarray:
    """Pixels that edges of n shapes pass through in their windows: bool [n, size, size].

    From left to right an edge enters a pixel at its start, where it crosses into a column, and where
    it crosses into a row. One that runs along a column or row is drawn as a straight run, or not at
    all where it lies on the boundary between two.
    """
    flip = edges.x0 > edges.x1
    x0, x1 = np.where(flip, edges.x1, edges.x0), np.where(flip, edges.x0, edges.x1)
    y0, y1 = np.where(flip, edges.y1, edges.y0), np.where(flip, edges.y0, edges.y1)
    on = lambda v: np.abs(v - np.round(v)) < ALIGNED
    whole = lambda v: np.floor(v).clip(-(2.0**62), 2.0**62).astype(np.int64)
    top, left = row[edges.shape], col[edges.shape]
    out = np.zeros((edges.n, size + 2, size + 2), bool)

    def burn(which: np.ndarray, r: np.ndarray, k: np.ndarray) -> None:
        s = edges.shape[which]
        out[s, (r - row[s] + 1).clip(0, size + 1), (k - col[s] + 1).clip(0, size + 1)] = True

    upright = np.abs(x0 - x1) < ALONG
    level = ~upright & (np.abs(y0 - y1) < ALONG)
    ends = lambda a, b: (whole(np.minimum(a, b)), whole(np.maximum(a, b) - ALIGNED))
    some = np.flatnonzero(upright & ~(on(x0) & on(x1)))
    a, b = ends(y0[some], y1[some])
    i, r = _each(np.maximum(a, top[some]), np.minimum(b, top[some] + size - 1))
    burn(some[i], r, whole(x1[some])[i])
    some = np.flatnonzero(level & ~(on(y0) & on(y1)))
    a, b = ends(x0[some], x1[some])
    i, k = _each(np.maximum(a, left[some]), np.minimum(b, left[some] + size - 1))
    burn(some[i], whole(y0[some])[i], k)
    some = np.flatnonzero(~upright & ~level)
    x, y, x_end, y_end = (v[some] for v in (x0, y0, x1, y1))
    slope = (y_end - y) / (x_end - x)
    burn(some, whole(y), whole(x))
    i, k = _each(np.maximum(whole(x) + 1, left[some] - 1), np.minimum(whole(np.ceil(x_end)) - 1, left[some] + size))
    burn(some[i], whole(y[i] + (k - x[i]) * slope[i]), k)
    down = slope > 0
    first = np.where(down, whole(y) + 1, whole(y_end) + 1)  # rows whose upper boundary is crossed
    last = np.where(down, whole(np.ceil(y_end)) - 1, whole(y))
    i, r = _each(np.maximum(first, top[some] - 1), np.minimum(last, top[some] + size + 1))
    at = x[i] + (r - y[i]) / slope[i]
    ok = (at >= x[i]) & (at < x_end[i])
    i, r, at = i[ok], r[ok], at[ok]
    burn(some[i], np.where(down[i], r, r - 1), whole(at))
    return out[:, 1:-1, 1:-1]


def clipped(edges: Edges, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, with_bounds: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Area [n] of n shapes within their frames and the bounds [n, 4] (x0, y0, x1, y1) of what is within; not a number where nothing is.

    The area is the integral of the frame's width to the right of the boundary over all edges; bounds
    are those of the edges' parts in the frame and of the frame's corners inside the shape.
    """
    s = edges.shape
    left, top, right, bottom = (v[s].astype(np.float64) for v in (x0, y0, x1, y1))
    dx, dy = edges.x1 - edges.x0, edges.y1 - edges.y0
    with np.errstate(divide="ignore", invalid="ignore"):
        along = lambda y: np.where(dy != 0, edges.x0 + (y - edges.y0) * dx / dy, edges.x0)
        ya, yb = (np.minimum(np.maximum(v, top), bottom) for v in (edges.y0, edges.y1))
        a, b = along(ya) - left, along(yb) - left
        width = right - left

        def total(u: np.ndarray) -> np.ndarray:
            inner = u.clip(0, width)
            return np.where(u < 0, width * u, width * inner - inner * inner / 2)

        level = np.abs(b - a) < 1e-9
        mean = np.where(level, width - ((a + b) / 2).clip(0, width), (total(b) - total(a)) / np.where(level, 1, b - a))
        area = np.abs(np.bincount(s, edges.w * (yb - ya) * mean, edges.n))
        if not with_bounds:
            return area, None
        # The part of each edge in its frame, as a range of its length.
        t0, t1 = np.zeros(len(s)), np.ones(len(s))
        for p, d, low, high in ((edges.x0, dx, left, right), (edges.y0, dy, top, bottom)):
            enter, leave = np.where(d > 0, low - p, high - p) / d, np.where(d > 0, high - p, low - p) / d
            still = (p >= low) & (p <= high)
            t0 = np.maximum(t0, np.where(d != 0, enter, np.where(still, 0, 2)))
            t1 = np.minimum(t1, np.where(d != 0, leave, 1))
    ok = t1 > t0
    xa, xb, ya, yb = (np.where(t == 0, p, np.where(t == 1, q, p + t * d)) for p, q, d, t in ((edges.x0, edges.x1, dx, t0), (edges.x0, edges.x1, dx, t1), (edges.y0, edges.y1, dy, t0), (edges.y0, edges.y1, dy, t1)))
    for v in (left, right):
        ok &= ~((xa == v) & (xb == v))
    for v in (top, bottom):
        ok &= ~((ya == v) & (yb == v))
    bounds = np.column_stack([np.full((edges.n, 2), np.inf), np.full((edges.n, 2), -np.inf)])
    for x, y in ((xa, ya), (xb, yb)):
        x, y = x[ok].clip(left[ok], right[ok]), y[ok].clip(top[ok], bottom[ok])
        for k, (f, v) in enumerate(((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))):
            f.at(bounds[:, k], s[ok], v)
    for x, nudge_x in ((x0, 1e-7), (x1, -1e-7)):
        for y, nudge_y in ((y0, 1e-7), (y1, -1e-7)):
            px, py = x[s] + nudge_x, y[s] + nudge_y
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = ((edges.y0 <= py) != (edges.y1 <= py)) & (edges.x0 + (py - edges.y0) * dx / dy <= px)
            inside = np.bincount(s[hit], minlength=edges.n) & 1 == 1
            for k, (f, v) in enumerate(((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))):
                bounds[inside, k] = f(bounds[inside, k], v[inside])
    bounds[~np.isfinite(bounds).all(1) | (area <= 0)] = np.nan
    return area, bounds

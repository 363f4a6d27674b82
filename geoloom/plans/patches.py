"""Queries of the spatial joins, rasterization and targets on parts as patches and customers as labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import alignment as AL
from geoloom.operators import burn as B
from geoloom.operators import dataset as D
from geoloom.operators import features as FT
from geoloom.operators import raster as R
from geoloom.operators import shapes as Z
from geoloom.operators import spatial as S
from geoloom.operators import targets as G
from geoloom.plans.tables import ANCHORS, FEATURES, PATCH, anchors, features, sql, table

c = F.col


def patches(spark, sf_dir) -> DataFrame:
    return anchors(spark, sf_dir).select(c("id").alias("patch"), "row", "col")


def labels(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).withColumnRenamed("id", "feature")


def boxes_as_shapes(boxes: DataFrame) -> DataFrame:
    """Pixel boxes (feature, class_id, r0, r1, c0, c1) as polygons of four corners, dealt over tasks: a small file is read by one."""
    dealt = boxes.select("feature", "class_id", "r0", "r1", "c0", "c1").repartition("feature")
    return Z.shapes(dealt.select("feature", "class_id", Z.box_parts().alias("parts")))


def shapes(spark, sf_dir) -> DataFrame:
    return boxes_as_shapes(labels(spark, sf_dir))


def valid_patches(spark, sf_dir) -> DataFrame:
    """Patches on a raster of 2500 x 2380 pixels: beyond it they are padding."""
    return B.within(patches(spark, sf_dir), 2500, 2380)


def areas(spark, sf_dir) -> DataFrame:
    """Every customer's box as an area of interest, named by nation: some patches lie in none."""
    named = table(spark, sf_dir, "customer").select(c("c_custkey").alias("feature"), F.concat(F.lit("n"), (c("c_nationkey") % 7).cast("string")).alias("name"))
    return labels(spark, sf_dir).join(named, "feature").select("feature", "name", "r0", "r1", "c0", "c1")


AREAS = "areas AS (SELECT id AS feature, 'n' || CAST(c_nationkey % 7 AS VARCHAR) AS name, r0, r1, c0, c1 FROM features JOIN customer ON c_custkey = id)"
MEET = f"meet AS (SELECT a.id AS patch, f.id AS feature, f.class_id, a.\"row\" AS ar, a.col AS ac, greatest(a.\"row\", f.r0) AS v0, least(a.\"row\" + {PATCH}, f.r1) AS v1, greatest(a.col, f.c0) AS h0, least(a.col + {PATCH}, f.c1) AS h1, (f.r1 - f.r0) * (f.c1 - f.c0) AS area_all FROM anchors a JOIN features f ON f.r0 < a.\"row\" + {PATCH} AND f.r1 > a.\"row\" AND f.c0 < a.col + {PATCH} AND f.c1 > a.col)"
BURNED = "burned AS (SELECT r, c, arg_max(class_id, id) AS class_id, max(id) AS feature FROM (SELECT id, class_id, r, unnest(range(c0, c1)) AS c FROM (SELECT *, unnest(range(r0, r1)) AS r FROM features)) GROUP BY r, c)"
IN_PATCH = f"inpatch AS (SELECT a.id AS patch, b.* FROM (SELECT *, r // {PATCH} AS k FROM burned) b JOIN anchors a ON b.k = a.\"row\" // {PATCH} AND b.c >= a.col AND b.c < a.col + {PATCH})"
COUNTS = f"counts AS (SELECT patch, class_id, count(*) AS pixels FROM inpatch GROUP BY ALL UNION ALL SELECT id, 0, {PATCH * PATCH} - coalesce(n, 0) FROM anchors LEFT JOIN (SELECT patch, count(*) AS n FROM inpatch GROUP BY patch) ON id = patch WHERE {PATCH * PATCH} - coalesce(n, 0) > 0)"


def v7_overlaps(spark, sf_dir) -> DataFrame:
    return S.overlaps(patches(spark, sf_dir), labels(spark, sf_dir), PATCH).select("patch", "feature")


def v11_clipped(spark, sf_dir) -> DataFrame:
    return S.overlaps(patches(spark, sf_dir), labels(spark, sf_dir), PATCH).select("patch", "feature", "v0", "v1", "h0", "h1")


def a14_kept(spark, sf_dir) -> DataFrame:
    return S.kept(patches(spark, sf_dir), areas(spark, sf_dir), PATCH).select("patch", "row", "col")


def a15_region_of(spark, sf_dir) -> DataFrame:
    return S.region_of(patches(spark, sf_dir), areas(spark, sf_dir), PATCH)


def v5_burned(spark, sf_dir) -> DataFrame:
    return B.row_sums(shapes(spark, sf_dir))


def polygons(spark, sf_dir) -> DataFrame:
    """A star of five points for each supplier, as edges."""
    k = c("s_suppkey")
    corner = lambda i: ((k * 13) % 400 + 30 + 28.25 * F.cos(F.radians(F.lit(144.0) * i + k)), (k * 29) % 400 + 30 + 28.25 * F.sin(F.radians(F.lit(144.0) * i + k)))
    edges = []
    for i in range(5):
        (x0, y0), (x1, y1) = corner(i), corner((i + 1) % 5)
        edges.append(F.struct(F.round(x0, 3).alias("x0"), F.round(y0, 3).alias("y0"), F.round(x1, 3).alias("x1"), F.round(y1, 3).alias("y1")))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.inline(F.array(*edges)))


def v1_fill(spark, sf_dir) -> DataFrame:
    return S.filled_spans(polygons(spark, sf_dir), ["id"])


def v10_point_boxes(spark, sf_dir) -> DataFrame:
    """Points as squares of five pixels."""
    k = c("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), FT.point_boxes((k * 13) % 400, (k * 29) % 400, 5.0).alias("b")).select("id", "b.*")


def g1_mask(spark, sf_dir) -> DataFrame:
    """The runs of equal class in each row of each patch's mask."""
    return B.mask_runs(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)


def g18_class_pixels(spark, sf_dir) -> DataFrame:
    return G.class_pixels(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)


def g3_accepts(spark, sf_dir) -> DataFrame:
    return G.labelled(g18_class_pixels(spark, sf_dir), PATCH, 0.05)


def g5_detections(spark, sf_dir) -> DataFrame:
    return G.detections(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)


def g6_accepts_detections(spark, sf_dir) -> DataFrame:
    """Patches that kept detections cover by a tenth or more, overlaps counted once."""
    a, b = patches(spark, sf_dir), shapes(spark, sf_dir)
    return G.accepts_detections(a, b, G.detections(a, b, PATCH), PATCH, 0.1)


def g7_large_objects(spark, sf_dir) -> DataFrame:
    """By class the objects that no patch can show well, of all."""
    big = F.greatest(c("r1") - c("r0"), c("c1") - c("c0")) > 48
    return labels(spark, sf_dir).groupBy("class_id").agg(F.count_if(big).alias("large"), F.count(F.lit(1)).alias("objects"))


def g8_instances(spark, sf_dir) -> DataFrame:
    return G.instances(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH).drop("counts")


def g8_instance_ids(spark, sf_dir) -> DataFrame:
    """Pixels of each instance in the id mask, where a later one lies on top."""
    return B.feature_pixels(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)


def g10_classes(spark, sf_dir) -> DataFrame:
    found = G.patch_classes(g18_class_pixels(spark, sf_dir), 0.02, background=True)
    return found.select("patch", "single", F.array_join(c("multi").cast("array<string>"), " ").alias("multi"))


def _changes(spark, sf_dir, with_areas: bool) -> DataFrame:
    """Two classes before, the others after: changed and equal pixels, of those that a set labels, by row."""
    all_ = labels(spark, sf_dir)
    sides = [all_.where(w) for w in ("class_id <= 2", "class_id > 2")]
    before, after = (boxes_as_shapes(x) for x in sides)
    wider = tuple(boxes_as_shapes(x.withColumns({"r1": c("r1") + 30, "c1": c("c1") + 40})) for x in sides) if with_areas else None

    def body(p, changed, known) -> tuple:
        some = known & ((p.classes(0) > 0) | (p.classes(1) > 0))
        which, r = np.nonzero(some.any(2))
        return which, p.row[which] + r, changed[which, r].sum(1), (some & ~changed)[which, r].sum(1)

    tiles = B.tiles(before.unionByName(after))
    found = B.change(tiles, before, after, B.TILE, body, "r long, changed long, same long", wider)
    return found.groupBy("r").agg(F.sum("changed").alias("changed"), F.sum("same").alias("same"))


def g12_change(spark, sf_dir) -> DataFrame:
    return _changes(spark, sf_dir, False)


def g12_change_areas(spark, sf_dir) -> DataFrame:
    """The same where both sets have annotated areas, around their labels: elsewhere nothing is known."""
    return _changes(spark, sf_dir, True)


def g10_valid_classes(spark, sf_dir) -> DataFrame:
    """Classes of patches by their valid pixels; those beyond the raster have none and are left out."""
    counts = G.class_pixels(valid_patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)
    found = G.patch_classes(counts, 0.02, background=True)
    return found.select("patch", "single", F.array_join(c("multi").cast("array<string>"), " ").alias("multi"))


def g5_valid_detections(spark, sf_dir) -> DataFrame:
    """Detections of what lies on the raster."""
    return G.detections(valid_patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)


def g21_object_counts(spark, sf_dir) -> DataFrame:
    return G.detections(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH).groupBy("patch", "class_id").agg(F.count(F.lit(1)).alias("objects"))


def m11_label_summary(spark, sf_dir) -> DataFrame:
    inside = (c("r0") < 1300) & (c("r1") > 200) & (c("c0") < 1800) & (c("c1") > 300)
    return D.label_summary(labels(spark, sf_dir), "class_name", inside)


def r2_aligned(spark, sf_dir) -> DataFrame:
    """Every patch's pixel looked up in a coarser raster of parts, of factor 3 and shifted by (5, 2): 0 and invalid outside."""
    k = c("p_partkey")
    coarse = table(spark, sf_dir, "part").select(F.floor(k / 30).alias("r"), (k % 30).alias("c"), c("p_size").cast("bigint").alias("value"))
    fine = patches(spark, sf_dir).select("patch", (c("row") % 130).alias("r"), (c("col") % 100).alias("c"))
    return AL.on_grid(fine, coarse, 3, 5, 2).select("patch", "value", "valid")


def r5_label_lookup(spark, sf_dir) -> DataFrame:
    """Pixel centres of one grid found in another of 2.5 units: row and column, -1 outside."""
    at = AL.label_pixel(c("row"), c("col"), (1, 0, 0, 0, 1, 0), (2.5, 0, 20, 0, 2.5, 10), 900, 800)
    return patches(spark, sf_dir).select("patch", at.alias("at")).select("patch", "at.r", "at.c")


def r11_classified(spark, sf_dir) -> DataFrame:
    """Raster values to classes: some mapped, some ignored, the rest background."""
    found = AL.classified((c("p_size") % 10).cast("bigint"), {0: 10, 1: 20, 2: 20, 7: 30}, (8, 9))
    return anchors(spark, sf_dir).select(c("id").alias("patch"), found.alias("class_id"))


_STAR = ", ".join(f"round((s_suppkey * 13) % 400 + 30 + 28.25 * cos(radians(144e0 * {i} + s_suppkey)), 3) AS x{i}, round((s_suppkey * 29) % 400 + 30 + 28.25 * sin(radians(144e0 * {i} + s_suppkey)), 3) AS y{i}" for i in range(5))
_EDGES = " UNION ALL ".join(f"SELECT id, x{i} AS x0, y{i} AS y0, x{(i + 1) % 5} AS x1, y{(i + 1) % 5} AS y1 FROM stars" for i in range(5))
_FILL = f"""WITH stars AS (SELECT s_suppkey AS id, {_STAR} FROM supplier), edges AS ({_EDGES}),
rows AS (SELECT *, unnest(range(CAST(ceil(least(y0, y1) - 0.5) AS BIGINT), CAST(ceil(greatest(y0, y1) - 0.5) AS BIGINT))) AS r FROM edges WHERE y0 <> y1),
hits AS (SELECT id, r, CAST(floor(x0 + (r + 0.5e0 - y0) * (x1 - x0) / (y1 - y0) + 0.5) AS BIGINT) AS x FROM rows),
ranked AS (SELECT *, row_number() OVER w AS n, lead(x) OVER w AS nx FROM hits WINDOW w AS (PARTITION BY id, r ORDER BY x))
SELECT id, r, x AS c0, nx AS c1 FROM ranked WHERE n % 2 = 1 AND nx > x"""
_SHARE = "(v1 - v0) * (h1 - h0) / area_all >= 0.3e0 - 1e-9"

QUERIES = {
    "v1_fill": (v1_fill, _FILL),
    "v5_burned": (v5_burned, sql("SELECT r, class_id, count(*) AS pixels, sum(c)::BIGINT AS cols, sum(feature)::BIGINT AS features FROM burned GROUP BY r, class_id", FEATURES, BURNED)),
    "v7_overlaps": (v7_overlaps, sql("SELECT patch, feature FROM meet", ANCHORS, FEATURES, MEET)),
    "v10_point_boxes": (v10_point_boxes, "SELECT s_suppkey AS id, (s_suppkey * 13) % 400 - 2.5e0 AS x0, (s_suppkey * 29) % 400 - 2.5e0 AS y0, (s_suppkey * 13) % 400 + 2.5e0 AS x1, (s_suppkey * 29) % 400 + 2.5e0 AS y1 FROM supplier"),
    "v11_clipped": (v11_clipped, sql("SELECT patch, feature, v0, v1, h0, h1 FROM meet", ANCHORS, FEATURES, MEET)),
    "a14_kept": (a14_kept, sql(f"SELECT id AS patch, \"row\", col FROM anchors a WHERE EXISTS (SELECT 1 FROM areas f WHERE f.r0 < a.\"row\" + {PATCH} AND f.r1 > a.\"row\" AND f.c0 < a.col + {PATCH} AND f.c1 > a.col)", ANCHORS, FEATURES, AREAS)),
    "a15_region_of": (a15_region_of, sql(f"SELECT id AS patch, coalesce(name, '') AS name FROM anchors LEFT JOIN (SELECT patch, name FROM (SELECT a.id AS patch, f.name, sum((least(a.\"row\" + {PATCH}, f.r1) - greatest(a.\"row\", f.r0)) * (least(a.col + {PATCH}, f.c1) - greatest(a.col, f.c0))) AS s FROM anchors a JOIN areas f ON f.r0 < a.\"row\" + {PATCH} AND f.r1 > a.\"row\" AND f.c0 < a.col + {PATCH} AND f.c1 > a.col GROUP BY ALL) JOIN (SELECT name, min(feature) AS o FROM areas GROUP BY name) USING (name) QUALIFY row_number() OVER (PARTITION BY patch ORDER BY s DESC, o) = 1) ON id = patch", ANCHORS, FEATURES, AREAS)),
    "g1_mask": (g1_mask, sql("SELECT patch, r, class_id, min(c) AS c0, max(c) + 1 AS c1 FROM (SELECT patch, class_id, r, c, c - row_number() OVER (PARTITION BY patch, r, class_id ORDER BY c) AS g FROM (SELECT p.patch, p.class_id, p.r - a.\"row\" AS r, p.c - a.col AS c FROM inpatch p JOIN anchors a ON a.id = p.patch)) GROUP BY patch, r, class_id, g", ANCHORS, FEATURES, BURNED, IN_PATCH)),
    "g3_accepts": (g3_accepts, sql(f"SELECT patch, count(*) / {float(PATCH * PATCH)}::DOUBLE AS share FROM inpatch GROUP BY patch HAVING share >= 0.05", ANCHORS, FEATURES, BURNED, IN_PATCH)),
    "g5_detections": (g5_detections, sql(f"SELECT patch, feature, class_id, CAST(h0 - ac AS DOUBLE) AS x, CAST(v0 - ar AS DOUBLE) AS y, CAST(h1 - h0 AS DOUBLE) AS w, CAST(v1 - v0 AS DOUBLE) AS h, CAST((v1 - v0) * (h1 - h0) AS DOUBLE) AS area, (v1 - v0) * (h1 - h0) < area_all AS truncated FROM meet WHERE {_SHARE} AND v1 - v0 >= 2 AND h1 - h0 >= 2", ANCHORS, FEATURES, MEET)),
    "g6_accepts_detections": (g6_accepts_detections, sql(f"SELECT patch, count(*) AS covered FROM (SELECT DISTINCT patch, r, unnest(range(h0, h1)) AS c FROM (SELECT *, unnest(range(v0, v1)) AS r FROM meet WHERE {_SHARE} AND v1 - v0 >= 2 AND h1 - h0 >= 2)) GROUP BY patch HAVING covered >= {0.1 * PATCH * PATCH}", ANCHORS, FEATURES, MEET)),
    "g7_large_objects": (g7_large_objects, sql("SELECT class_id, count(*) FILTER (WHERE greatest(r1 - r0, c1 - c0) > 48) AS large, count(*) AS objects FROM features GROUP BY class_id", FEATURES)),
    "g8_instances": (g8_instances, sql(f"SELECT patch, feature, class_id, h0 - ac AS x, v0 - ar AS y, h1 - h0 AS w, v1 - v0 AS h, (v1 - v0) * (h1 - h0) AS area, (v1 - v0) * (h1 - h0) < area_all AS truncated FROM meet WHERE {_SHARE} AND (v1 - v0) * (h1 - h0) >= 4", ANCHORS, FEATURES, MEET)),
    "g8_instance_ids": (g8_instance_ids, sql("SELECT patch, feature, count(*) AS pixels FROM inpatch GROUP BY ALL", ANCHORS, FEATURES, BURNED, IN_PATCH)),
    "g10_classes": (g10_classes, sql("SELECT id AS patch, coalesce(single, 0) AS single, coalesce(multi, '0') AS multi FROM anchors LEFT JOIN (SELECT patch, arg_max(class_id, pixels * 1000 - class_id) AS single, string_agg(CAST(class_id AS VARCHAR), ' ' ORDER BY class_id) AS multi FROM (SELECT *, pixels / sum(pixels) OVER (PARTITION BY patch) AS s FROM counts) WHERE class_id <> 0 AND s >= 0.02e0 GROUP BY patch) ON id = patch", ANCHORS, FEATURES, BURNED, IN_PATCH, COUNTS)),
    "g12_change": (g12_change, sql("SELECT r, count(*) FILTER (WHERE coalesce(a, 0) <> coalesce(b, 0)) AS changed, count(*) FILTER (WHERE coalesce(a, 0) = coalesce(b, 0)) AS same FROM (SELECT r, c, arg_max(class_id, id) FILTER (WHERE class_id <= 2) AS a, arg_max(class_id, id) FILTER (WHERE class_id > 2) AS b FROM (SELECT id, class_id, r, unnest(range(c0, c1)) AS c FROM (SELECT *, unnest(range(r0, r1)) AS r FROM features)) GROUP BY r, c) GROUP BY r", FEATURES)),
    "g12_change_areas": (g12_change_areas, sql("SELECT r, count(*) FILTER (WHERE coalesce(a, 0) <> coalesce(b, 0)) AS changed, count(*) FILTER (WHERE coalesce(a, 0) = coalesce(b, 0)) AS same FROM (SELECT r, c, arg_max(class_id, id) FILTER (WHERE class_id <= 2 AND own) AS a, arg_max(class_id, id) FILTER (WHERE class_id > 2 AND own) AS b, bool_or(own) AS seen, bool_or(class_id <= 2) AS in_a, bool_or(class_id > 2) AS in_b FROM (SELECT id, class_id, r, c, r < r1 AND c < c1 AS own FROM (SELECT *, unnest(range(c0, c1 + 40)) AS c FROM (SELECT *, unnest(range(r0, r1 + 30)) AS r FROM features))) GROUP BY r, c) WHERE seen AND in_a AND in_b GROUP BY r", FEATURES)),
    "g10_valid_classes": (g10_valid_classes, sql("SELECT id AS patch, coalesce(single, 0) AS single, coalesce(multi, '0') AS multi FROM inside LEFT JOIN (SELECT patch, arg_max(class_id, pixels * 1000 - class_id) AS single, string_agg(CAST(class_id AS VARCHAR), ' ' ORDER BY class_id) AS multi FROM (SELECT patch, class_id, count(*) AS pixels, count(*) / any_value(valid) AS s FROM inpatch JOIN inside ON id = patch WHERE r < 2500 AND c < 2380 GROUP BY patch, class_id) WHERE s >= 0.02e0 GROUP BY patch) ON id = patch", ANCHORS, FEATURES, BURNED, IN_PATCH, f"inside AS (SELECT * FROM (SELECT id, greatest(0, least(\"row\" + {PATCH}, 2500) - \"row\") * greatest(0, least(col + {PATCH}, 2380) - col) AS valid FROM anchors) WHERE valid > 0)")),
    "g5_valid_detections": (g5_valid_detections, sql(f"SELECT patch, feature, class_id, CAST(h0 - ac AS DOUBLE) AS x, CAST(v0 - ar AS DOUBLE) AS y, CAST(h1 - h0 AS DOUBLE) AS w, CAST(v1 - v0 AS DOUBLE) AS h, CAST((v1 - v0) * (h1 - h0) AS DOUBLE) AS area, (v1 - v0) * (h1 - h0) < area_all AS truncated FROM (SELECT * REPLACE (least(v1, 2500) AS v1, least(h1, 2380) AS h1) FROM meet) WHERE v1 > v0 AND h1 > h0 AND {_SHARE} AND v1 - v0 >= 2 AND h1 - h0 >= 2", ANCHORS, FEATURES, MEET)),
    "g18_class_pixels": (g18_class_pixels, sql("SELECT patch, class_id, pixels FROM counts", ANCHORS, FEATURES, BURNED, IN_PATCH, COUNTS)),
    "g21_object_counts": (g21_object_counts, sql(f"SELECT patch, class_id, count(*) AS objects FROM meet WHERE {_SHARE} AND v1 - v0 >= 2 AND h1 - h0 >= 2 GROUP BY ALL", ANCHORS, FEATURES, MEET)),
    "m11_label_summary": (m11_label_summary, sql("SELECT class_name, count(*) AS features, count(*) FILTER (WHERE r0 < 1300 AND r1 > 200 AND c0 < 1800 AND c1 > 300) AS in_region FROM features GROUP BY class_name", FEATURES)),
    "r2_aligned": (r2_aligned, sql("SELECT f.id AS patch, coalesce(CAST(p.p_size AS BIGINT), 0) AS value, p.p_size IS NOT NULL AS valid FROM (SELECT id, CAST(floor((\"row\" % 130 - 5) / 3) AS BIGINT) AS rr, CAST(floor((col % 100 - 2) / 3) AS BIGINT) AS cc FROM anchors) f LEFT JOIN part p ON rr >= 0 AND cc >= 0 AND cc < 30 AND p.p_partkey = rr * 30 + cc", ANCHORS)),
    "r5_label_lookup": (r5_label_lookup, sql("SELECT id AS patch, CASE WHEN r >= 0 AND r < 900 THEN r ELSE -1 END AS r, CASE WHEN c >= 0 AND c < 800 THEN c ELSE -1 END AS c FROM (SELECT id, CAST(floor((\"row\" + 0.5e0 - 10) / 2.5e0 + 1e-10) AS BIGINT) AS r, CAST(floor((col + 0.5e0 - 20) / 2.5e0 + 1e-10) AS BIGINT) AS c FROM anchors)", ANCHORS)),
    "r11_classified": (r11_classified, sql("SELECT id AS patch, CAST(CASE p_size % 10 WHEN 8 THEN 255 WHEN 9 THEN 255 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 20 WHEN 7 THEN 30 ELSE 0 END AS BIGINT) AS class_id FROM anchors", ANCHORS)),
}

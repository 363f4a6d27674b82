"""Queries of the splitter on parts as patches of 64 pixels."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import raster as R
from geoloom.operators import splits as P
from geoloom.plans.masks import PIXELS, pixels
from geoloom.plans.tables import ANCHORS, PATCH, anchors, sql, table

c = F.col
BLOCK = 256


def patches(spark, sf_dir) -> DataFrame:
    return anchors(spark, sf_dir).select("id", "row", "col", c("p_brand").alias("stratum"))


def p2_entry_class(spark, sf_dir) -> DataFrame:
    """Each row of pixels as an entry."""
    rows = pixels(spark, sf_dir).groupBy("id", "r").agg(F.bool_or(c("class_id") == 0).alias("bg"), F.bool_or(c("class_id") != 0).alias("fg"), F.avg((c("v") <= 0).cast("double")).alias("e"))
    return rows.select("id", "r", P.entry_class(c("bg"), c("fg"), c("e")).alias("class"))


def p3_stratum(spark, sf_dir) -> DataFrame:
    """The most frequent foreground class, the first by name of equals."""
    counts = R.histogram(pixels(spark, sf_dir).where("class_id <> 0"), ["id"])
    return counts.groupBy("id").agg(F.min_by("class_id", F.struct((-c("pixels")).alias("n"), c("class_id").cast("string").alias("s"))).alias("stratum"))


def p4_sizes(spark, sf_dir) -> DataFrame:
    counts = patches(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("stratum", "n", P.test_size(c("n"), 0.2).alias("test"), P.val_size(c("n"), 0.2, 0.1).alias("val"))


def p5_assigned(spark, sf_dir) -> DataFrame:
    groups = patches(spark, sf_dir).groupBy(c("stratum").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    return P.assigned(groups.withColumn("order", P.order_key(42, c("group"))), 0.2, 0.1)


def p6_overlapping(spark, sf_dir) -> DataFrame:
    df = patches(spark, sf_dir)
    return P.overlapping(df.where("stratum <> 'Brand#12'"), df.where("stratum = 'Brand#12'"), PATCH).select("id")


def p7_default_block(spark, sf_dir) -> DataFrame:
    df = patches(spark, sf_dir)
    return spark.createDataFrame([(P.default_block(df, PATCH),)], "block bigint")


def p8_spatial_split(spark, sf_dir) -> DataFrame:
    return P.spatial_split(patches(spark, sf_dir).drop("stratum"), "id", PATCH, BLOCK)


def p9_region_split(spark, sf_dir) -> DataFrame:
    return P.grouped_split(patches(spark, sf_dir), "id", c("stratum"), None).select("id", "split")


def p10_stratified_split(spark, sf_dir) -> DataFrame:
    return P.stratified_split(patches(spark, sf_dir), "id", ["stratum"]).select("id", "split")


def p11_random_split(spark, sf_dir) -> DataFrame:
    return P.random_split(patches(spark, sf_dir), "id").select("id", "split")


def p12_sampled(spark, sf_dir) -> DataFrame:
    return P.sampled(patches(spark, sf_dir), "id", ["stratum"], 333).select("id")


def p13_labelled(spark, sf_dir) -> DataFrame:
    train = P.random_split(patches(spark, sf_dir), "id").where("split = 'train'")
    return P.labelled(train, "id", 0.3).select("id", "labelled")


def p14_ratio_names(spark, sf_dir) -> DataFrame:
    """Folder names of ratios of labelled patches."""

    def run(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([P.ratio_name(r) for r in batch.column(1).to_pylist()])], ["id", "name"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", (c("s_suppkey") % 97 / 96.0).alias("r")).mapInArrow(run, "id long, name string")


def p15_share_warnings(spark, sf_dir) -> DataFrame:
    return P.share_warnings(p9_region_split(spark, sf_dir))


def i5_split_checks(spark, sf_dir) -> DataFrame:
    """Patches that two lists with different seeds put into different splits."""
    a, b = (P.random_split(patches(spark, sf_dir), "id", seed=s).select("id", "split") for s in (1, 2))
    return P.in_several(a.unionByName(b), "id")


_RANK = "ranked AS (SELECT *, row_number() OVER ({by} ORDER BY md5('{seed}:' || id)) AS k, count(*) OVER ({by}) AS n FROM patches)"
_PATCHES = "patches AS (SELECT id, \"row\", col, p_brand AS stratum FROM anchors)"
_SPLIT = "CASE WHEN k <= ceil(n * 0.2e0) THEN 'test' WHEN k <= ceil(n * 0.2e0) + ceil((n - ceil(n * 0.2e0)) * 0.1e0) THEN 'val' ELSE 'train' END"


def _fold(group: str) -> str:
    """Recursive SQL that gives each group its split in the order of its hash."""
    return f"""sized AS (SELECT g, count(*) AS size, row_number() OVER (ORDER BY md5('42:' || g)) AS k FROM (SELECT {group} AS g FROM patches) GROUP BY g),
goal AS (SELECT ceil(sum(size) * 0.2e0) AS t, ceil((sum(size) - ceil(sum(size) * 0.2e0)) * 0.1e0) AS v FROM sized),
fold AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS g, ''::VARCHAR AS split, 0::BIGINT AS a, 0::BIGINT AS b
 UNION ALL SELECT s.k, s.g, CASE WHEN abs(a + size - t) < abs(a - t) THEN 'test' WHEN abs(b + size - v) < abs(b - v) THEN 'val' ELSE 'train' END,
 CASE WHEN abs(a + size - t) < abs(a - t) THEN a + size ELSE a END,
 CASE WHEN abs(a + size - t) < abs(a - t) THEN b WHEN abs(b + size - v) < abs(b - v) THEN b + size ELSE b END
 FROM fold f JOIN sized s ON s.k = f.k + 1, goal)"""


def _recursive(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + body


_BLOCK = f"CAST(\"row\" // {BLOCK} AS VARCHAR) || '_' || CAST(col // {BLOCK} AS VARCHAR)"
_NEAR = "EXISTS (SELECT 1 FROM {held} h WHERE abs(h.\"row\" - p.\"row\") < 64 AND abs(h.col - p.col) < 64)"

QUERIES = {
    "p2_entry_class": (p2_entry_class, sql("SELECT id, r, CAST(CASE WHEN bg AND NOT fg THEN 0 WHEN fg AND NOT bg THEN 1 ELSE 2 END AS BIGINT) AS \"class\" FROM (SELECT id, r, bool_or(class_id = 0) AS bg, bool_or(class_id <> 0) AS fg FROM pixels GROUP BY id, r)", PIXELS)),
    "p3_stratum": (p3_stratum, sql("SELECT id, class_id AS stratum FROM (SELECT id, class_id, count(*) AS n FROM pixels WHERE class_id <> 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, CAST(class_id AS VARCHAR)) = 1", PIXELS)),
    "p4_sizes": (p4_sizes, sql("SELECT stratum, n, CAST(ceil(n * 0.2e0) AS BIGINT) AS test, CAST(ceil((n - ceil(n * 0.2e0)) * 0.1e0) AS BIGINT) AS val FROM (SELECT stratum, count(*) AS n FROM patches GROUP BY stratum)", ANCHORS, _PATCHES)),
    "p5_assigned": (p5_assigned, _recursive("SELECT g AS \"group\", split FROM fold WHERE k > 0", ANCHORS, _PATCHES, _fold("stratum"))),
    "p6_overlapping": (p6_overlapping, sql("SELECT id FROM patches p WHERE stratum <> 'Brand#12' AND " + _NEAR.format(held="(SELECT * FROM patches WHERE stratum = 'Brand#12')"), ANCHORS, _PATCHES)),
    "p7_default_block": (p7_default_block, sql(f"SELECT CAST(greatest({PATCH}, least({4 * PATCH}, floor(floor(sqrt((max(\"row\") + {PATCH}) * (max(col) + {PATCH}) / 10e0)) / {PATCH}) * {PATCH})) AS BIGINT) AS block FROM patches", ANCHORS, _PATCHES)),
    "p8_spatial_split": (p8_spatial_split, _recursive(f"SELECT id, \"row\", col, CASE WHEN split = 'val' AND {_NEAR.format(held='tests')} THEN 'dropped' WHEN split = 'train' AND ({_NEAR.format(held='tests')} OR {_NEAR.format(held='vals')}) THEN 'dropped' ELSE split END AS split FROM split p", ANCHORS, _PATCHES, _fold(_BLOCK), f"split AS (SELECT id, \"row\", col, split FROM patches JOIN fold ON g = {_BLOCK} AND k > 0)", "tests AS (SELECT * FROM split WHERE split = 'test')", f"vals AS (SELECT * FROM split p WHERE split = 'val' AND NOT {_NEAR.format(held='tests')})")),
    "p9_region_split": (p9_region_split, _recursive("SELECT id, split FROM patches JOIN fold ON g = stratum AND k > 0", ANCHORS, _PATCHES, _fold("stratum"))),
    "p10_stratified_split": (p10_stratified_split, sql(f"SELECT id, {_SPLIT} AS split FROM ranked", ANCHORS, _PATCHES, _RANK.format(by="PARTITION BY stratum", seed=42))),
    "p11_random_split": (p11_random_split, sql(f"SELECT id, {_SPLIT} AS split FROM ranked", ANCHORS, _PATCHES, _RANK.format(by="", seed=42))),
    "p12_sampled": (p12_sampled, sql("SELECT id FROM ranked WHERE k <= round_even(n / (SELECT CAST(count(*) AS DOUBLE) FROM patches) * 333, 0)", ANCHORS, _PATCHES, _RANK.format(by="PARTITION BY stratum", seed=42))),
    "p13_labelled": (p13_labelled, sql(f"SELECT id, row_number() OVER (ORDER BY md5('42:' || id || ':labelled')) <= ceil(count(*) OVER () * 0.3e0) AS labelled FROM (SELECT id, {_SPLIT} AS split FROM ranked) WHERE split = 'train'", ANCHORS, _PATCHES, _RANK.format(by="", seed=42))),
    "p14_ratio_names": (p14_ratio_names, "SELECT s_suppkey AS id, format('{:g}', round((s_suppkey % 97) / 96e0 * 100, 4)) AS name FROM supplier"),
    "p15_share_warnings": (p15_share_warnings, _recursive("SELECT split, count(*) AS \"rows\", abs(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM patches) - CASE split WHEN 'test' THEN 0.2e0 WHEN 'val' THEN 0.08e0 ELSE 0.72e0 END) > 0.1 AS off FROM patches JOIN fold ON g = stratum AND k > 0 GROUP BY split", ANCHORS, _PATCHES, _fold("stratum"))),
    "i5_split_checks": (i5_split_checks, sql("SELECT id, CAST(2 AS BIGINT) AS splits FROM a JOIN b USING (id) WHERE sa <> sb", ANCHORS, _PATCHES, _RANK.format(by="", seed=1).replace("ranked AS", "ra AS"), _RANK.format(by="", seed=2).replace("ranked AS", "rb AS"), f"a AS (SELECT id, {_SPLIT} AS sa FROM ra)", f"b AS (SELECT id, {_SPLIT} AS sb FROM rb)")),
}

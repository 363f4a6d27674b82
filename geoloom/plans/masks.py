"""Queries of the raster, mask and statistics operators on the embeddings as patches of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import catalogue as CG
from geoloom.operators import dataset as D
from geoloom.operators import raster as R
from geoloom.plans.tables import sql, table

c = F.col


def pixels(spark, sf_dir) -> DataFrame:
    """id, label, r, c, v and a class by value."""
    rows = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), "label", F.posexplode("embedding").alias("at", "f"))
    v = c("f").cast("double")
    return rows.select("id", "label", F.floor(c("at") / 8).alias("r"), (c("at") % 8).cast("bigint").alias("c"), v.alias("v"), F.when(v < -0.1, 0).when(v < 0.05, 1).when(v < 0.2, 2).otherwise(3).cast("bigint").alias("class_id"))


PIXELS = "pixels AS (SELECT id, label, (p - 1) // 8 AS r, (p - 1) % 8 AS c, CAST(f AS DOUBLE) AS v, CAST(CASE WHEN CAST(f AS DOUBLE) < -0.1e0 THEN 0 WHEN CAST(f AS DOUBLE) < 0.05e0 THEN 1 WHEN CAST(f AS DOUBLE) < 0.2e0 THEN 2 ELSE 3 END AS BIGINT) AS class_id FROM (SELECT vec_id AS id, label, unnest(embedding) AS f, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS p FROM embeddings))"


def mask(spark, sf_dir) -> DataFrame:
    return pixels(spark, sf_dir).where("v > 0").select("id", "r", "c")


MASK = "mask AS (SELECT id, r, c FROM pixels WHERE v > 0)"
RUNS = "runs AS (SELECT id, r, min(c) AS c0, max(c) + 1 AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY id, r ORDER BY c) AS g FROM mask) GROUP BY id, r, g)"


def v13_runs(spark, sf_dir) -> DataFrame:
    return R.runs(mask(spark, sf_dir), ["id"])


def v14_rectangles(spark, sf_dir) -> DataFrame:
    return R.rectangles(mask(spark, sf_dir), ["id"])


def v15_rle(spark, sf_dir) -> DataFrame:
    return R.rle_counts(mask(spark, sf_dir), ["id"], 8, 8).select("id", F.array_join(c("counts").cast("array<string>"), ",").alias("counts"))


def v16_rle_text(spark, sf_dir) -> DataFrame:
    return R.rle_counts(mask(spark, sf_dir), ["id"], 8, 8).select("id", R.rle_text(c("counts")).alias("text"))


def v17_tight_box(spark, sf_dir) -> DataFrame:
    return R.tight_box(mask(spark, sf_dir), ["id"])


def g17_class_histogram(spark, sf_dir) -> DataFrame:
    return R.histogram(pixels(spark, sf_dir), ["id"])


def g19_empty_ratio(spark, sf_dir) -> DataFrame:
    return D.empty_ratio(pixels(spark, sf_dir), ["id"], c("class_id") == 0)


def g20_value_stats(spark, sf_dir) -> DataFrame:
    """Statistics of a continuous target with missing pixels."""
    v = R.rescaled(c("v"), 10.0, 1.0, -0.2, 0.2, None).cast("double")
    found = R.moments(pixels(spark, sf_dir).withColumn("t", v), ["id"], "t")
    return found.select("id", c("count").alias("valid"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), F.round("mean", 5).alias("mean"))


def g14_accepts_values(spark, sf_dir) -> DataFrame:
    v = R.rescaled(c("v"), 1.0, 0.0, -0.1, 0.1, None)
    return pixels(spark, sf_dir).groupBy("id").agg(F.avg((~F.isnan(v)).cast("double")).alias("share")).where("share >= 0.5")


def r13_rescaled(spark, sf_dir) -> DataFrame:
    v = R.rescaled(c("v"), 2.0, 0.5, -0.15, 0.3, None).cast("double")
    return pixels(spark, sf_dir).groupBy("label").agg(F.sum(F.isnan(v).cast("bigint")).alias("missing"), F.round(F.sum(F.when(~F.isnan(v), v)), 3).alias("total"))


def m1_moments(spark, sf_dir) -> DataFrame:
    found = R.moments(pixels(spark, sf_dir), ["label"], "v")
    return found.select(c("label").cast("bigint").alias("label"), "count", *[F.round(x, 8).alias(x) for x in ("mean", "std", "low", "high")])


def m2_band_summary(spark, sf_dir) -> DataFrame:
    """Statistics of each column of pixels as a band."""
    return R.moments(pixels(spark, sf_dir), ["c"], "v").select(c("c").alias("band"), "count", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


def m4_class_balance(spark, sf_dir) -> DataFrame:
    counts = R.histogram(pixels(spark, sf_dir), ["id"]).groupBy("class_id").agg(F.sum("pixels").alias("pixels"), F.count(F.lit(1)).alias("patches"))
    total = counts.agg(F.sum("pixels").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("class_id", "pixels", "patches", F.round(c("pixels") / c("total"), 10).alias("frequency"))


def m5_class_weights(spark, sf_dir) -> DataFrame:
    return R.median_frequency_weights(R.histogram(pixels(spark, sf_dir), ["id"]), "id").select("class_id", F.round("weight", 8).alias("weight"))


def m10_normalised(spark, sf_dir) -> DataFrame:
    rows = pixels(spark, sf_dir)
    stats = F.broadcast(R.moments(rows, ["c"], "v").select("c", "mean", "std"))  # a row for each of eight columns
    z = R.normalised(c("v"), c("mean"), c("std")).cast("double")
    return rows.join(stats, "c").groupBy("id").agg(F.round(F.sum(z), 3).alias("total"), F.round(F.max(z), 3).alias("high"))


def s29_nodata(spark, sf_dir) -> DataFrame:
    """Two bands a pixel: no data where both are zero after rounding."""
    rows = pixels(spark, sf_dir).groupBy("id", "r", F.floor(c("c") / 2).alias("p")).agg(F.sort_array(F.collect_list(F.struct("c", (F.round(c("v"), 1) + 0.0).alias("v"))))["v"].alias("bands"))
    return rows.groupBy("id").agg(F.sum(R.nodata(c("bands"), 0.0).cast("bigint")).alias("empty"))


def s27_mosaic(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return R.first_valid(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "l_extendedprice", c("l_discount") > 0).select(c("l_partkey").alias("pixel"), c("l_extendedprice").alias("value"))


def s35_composite(spark, sf_dir) -> DataFrame:
    """Per pixel the reducers of a stack of images: median, mean, least, largest, and last on top."""
    rows = table(spark, sf_dir, "lineitem").withColumn("pixel", c("l_partkey"))
    found = CG.composite(rows, ["pixel"], "l_quantity", ["l_shipdate", "l_orderkey", "l_linenumber"])
    return found.withColumn("mean", F.round("mean", 6))


def s32_band_gaps(spark, sf_dir) -> DataFrame:
    """Columns of pixels that are empty in a patch where others have data."""
    return CG.band_gaps(pixels(spark, sf_dir), ["id"], "c", c("v") > 0.1).withColumnRenamed("c", "band")


def a23_reflected(spark, sf_dir) -> DataFrame:
    """Patches of 12 rows cut from 8, the rest mirrored: the mean of each row."""
    rows = pixels(spark, sf_dir).groupBy("id", "r").agg(F.avg("v").alias("v"))
    places = spark.range(12).select(c("id").alias("place"), R.reflected(c("id"), F.lit(8)).alias("r"))
    return rows.join(F.broadcast(places), "r").select("id", "place", F.round("v", 8).alias("v"))


def w28_blend(spark, sf_dir) -> DataFrame:
    """Patches at every fourth row of one long raster of each label, blended where they overlap."""
    rows = pixels(spark, sf_dir).select(c("label").cast("bigint").alias("label"), "r", "c", c("v").alias("score"), ((c("id") % 10) * 4 + c("r")).alias("row"), c("c").alias("col"))
    return R.blended(rows, ["label", "row", "col"], 8).select("label", "row", "col", F.round("score", 8).alias("score"))


def w28_argmax(spark, sf_dir) -> DataFrame:
    """The class of the highest mean score at each pixel, the first of equals."""
    rows = pixels(spark, sf_dir).groupBy("r", "c", "class_id").agg(F.round(F.avg(F.abs("v")), 9).alias("score"))
    return rows.groupBy("r", "c").agg(F.min_by("class_id", F.struct((-c("score")).alias("s"), "class_id")).alias("class_id"))


def w29_hann(spark, sf_dir) -> DataFrame:
    return spark.range(64).select("id", F.round(R.hann(c("id"), 64), 9).alias("weight"))


_HANN = "(sin(pi() * (r + 0.5) / 8) ** 2 * sin(pi() * (c + 0.5) / 8) ** 2)"
_RESCALE = "CASE WHEN v < {lo} OR v > {hi} THEN NULL ELSE CAST(CAST(v * {s} + {o} AS FLOAT) AS DOUBLE) END"
_FREQ = "freq AS (SELECT class_id, sum(n) / sum(a) AS f FROM (SELECT class_id, n, sum(n) OVER (PARTITION BY id) AS a FROM (SELECT id, class_id, count(*) AS n FROM pixels GROUP BY ALL)) GROUP BY class_id)"

_RLE = sql("SELECT id, CASE WHEN first_v THEN '0,' ELSE '' END || counts AS counts FROM (SELECT id, bool_or(pos = 0 AND m) AS first_v FROM flat GROUP BY id) JOIN (SELECT id, string_agg(n, ',' ORDER BY lo) AS counts FROM (SELECT id, min(pos) AS lo, CAST(count(*) AS VARCHAR) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY id, m ORDER BY pos) AS g FROM flat) GROUP BY id, m, g) GROUP BY id) USING (id) WHERE id IN (SELECT id FROM mask)", PIXELS, MASK, "flat AS (SELECT id, c * 8 + r AS pos, v > 0 AS m FROM pixels)")

QUERIES = {
    "v13_runs": (v13_runs, sql("SELECT id, r, c0, c1 FROM runs", PIXELS, MASK, RUNS)),
    "v14_rectangles": (v14_rectangles, sql("SELECT id, c0, c1, min(r) AS r0, max(r) + 1 AS r1 FROM (SELECT *, r - row_number() OVER (PARTITION BY id, c0, c1 ORDER BY r) AS g FROM runs) GROUP BY id, c0, c1, g", PIXELS, MASK, RUNS)),
    "v15_rle": (v15_rle, _RLE),
    "v16_rle_text": (v16_rle_text, f"WITH k AS ({_RLE}), l AS (SELECT id, list_transform(string_split(counts, ','), lambda x: CAST(x AS BIGINT)) AS n FROM k), d AS (SELECT id, list_transform(range(1, len(n) + 1), lambda i: CASE WHEN i > 3 THEN n[i] - n[i - 2] ELSE n[i] END) AS d FROM l), g AS (SELECT id, list_transform(d, lambda x: CAST(floor(x / 32e0) AS INTEGER)) AS f, list_transform(d, lambda x: CAST(x - 32 * floor(x / 32e0) AS INTEGER)) AS g FROM d) SELECT id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN f[i] = CASE WHEN g[i] >= 16 THEN -1 ELSE 0 END THEN chr(g[i] + 48) ELSE chr(g[i] + 80) || chr(CAST(f[i] - 32 * floor(f[i] / 32e0) AS INTEGER) + 48) END), '') AS text FROM g"),
    "v17_tight_box": (v17_tight_box, sql("SELECT id, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h, count(*) AS area FROM mask GROUP BY id", PIXELS, MASK)),
    "g17_class_histogram": (g17_class_histogram, sql("SELECT id, class_id, count(*) AS pixels FROM pixels GROUP BY ALL", PIXELS)),
    "g19_empty_ratio": (g19_empty_ratio, sql("SELECT id, avg(CASE WHEN class_id = 0 THEN 1e0 ELSE 0e0 END) AS empty_ratio FROM pixels GROUP BY id", PIXELS)),
    "g20_value_stats": (g20_value_stats, sql(f"SELECT id, count(t) AS valid, round(min(t), 5) AS low, round(max(t), 5) AS high, round(avg(t), 5) AS mean FROM (SELECT id, {_RESCALE.format(lo='-0.2e0', hi='0.2e0', s='10e0', o='1e0')} AS t FROM pixels) GROUP BY id", PIXELS)),
    "g14_accepts_values": (g14_accepts_values, sql("SELECT id, avg(CASE WHEN v BETWEEN -0.1e0 AND 0.1e0 THEN 1e0 ELSE 0e0 END) AS share FROM pixels GROUP BY id HAVING share >= 0.5", PIXELS)),
    "r13_rescaled": (r13_rescaled, sql(f"SELECT label, count(*) - count(t) AS missing, round(sum(t), 3) AS total FROM (SELECT label, {_RESCALE.format(lo='-0.15e0', hi='0.3e0', s='2e0', o='0.5e0')} AS t FROM pixels) GROUP BY label", PIXELS)),
    "m1_moments": (m1_moments, sql("SELECT CAST(label AS BIGINT) AS label, count(v) AS count, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std, round(min(v), 8) AS low, round(max(v), 8) AS high FROM pixels GROUP BY label", PIXELS)),
    "m2_band_summary": (m2_band_summary, sql("SELECT c AS band, count(v) AS count, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std FROM pixels GROUP BY c", PIXELS)),
    "m4_class_balance": (m4_class_balance, sql("SELECT class_id, count(*) AS pixels, count(DISTINCT id) AS patches, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM pixels), 10) AS frequency FROM pixels GROUP BY class_id", PIXELS)),
    "m5_class_weights": (m5_class_weights, sql("SELECT class_id, round((SELECT median(f) FROM freq) / f, 8) AS weight FROM freq", PIXELS, _FREQ)),
    "m10_normalised": (m10_normalised, sql("SELECT id, round(sum(z), 3) AS total, round(max(z), 3) AS high FROM (SELECT id, CAST(CAST((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS FLOAT) AS DOUBLE) AS z FROM pixels JOIN (SELECT c, avg(v) AS m, stddev_pop(v) AS s FROM pixels GROUP BY c) USING (c)) GROUP BY id", PIXELS)),
    "s29_nodata": (s29_nodata, sql("SELECT id, sum(CASE WHEN a = 0 AND b = 0 THEN 1 ELSE 0 END)::BIGINT AS empty FROM (SELECT id, r, c // 2 AS p, min(abs(round(v, 1))) AS a, max(abs(round(v, 1))) AS b FROM pixels GROUP BY ALL) GROUP BY id", PIXELS)),
    "s27_mosaic": (s27_mosaic, "SELECT l_partkey AS pixel, l_extendedprice AS value FROM lineitem WHERE l_discount > 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1"),
    "s35_composite": (s35_composite, "SELECT l_partkey AS pixel, median(l_quantity) AS median, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS top FROM lineitem GROUP BY l_partkey"),
    "s32_band_gaps": (s32_band_gaps, sql("SELECT id, c AS band FROM (SELECT id, c, bool_or(v > 0.1e0) AS b FROM pixels GROUP BY id, c) QUALIFY NOT b AND bool_or(b) OVER (PARTITION BY id)", PIXELS)),
    "a23_reflected": (a23_reflected, sql("SELECT id, place, round(v, 8) AS v FROM (SELECT id, r, avg(v) AS v FROM pixels GROUP BY id, r) JOIN (SELECT range AS place, CASE WHEN range < 8 THEN range ELSE 14 - range END AS r FROM range(12)) USING (r)", PIXELS)),
    "w28_blend": (w28_blend, sql(f"SELECT CAST(label AS BIGINT) AS label, (id % 10) * 4 + r AS \"row\", c AS col, round(sum({_HANN} * v) / greatest(sum({_HANN}), 1e-12), 8) AS score FROM pixels GROUP BY ALL", PIXELS).replace(" GROUP BY ALL", " GROUP BY label, (id % 10) * 4 + r, c")),
    "w28_argmax": (w28_argmax, sql("SELECT r, c, class_id FROM (SELECT r, c, class_id, round(avg(abs(v)), 9) AS s FROM pixels GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY s DESC, class_id) = 1", PIXELS)),
    "w29_hann": (w29_hann, "SELECT range AS id, round(sin(pi() * (range + 0.5) / 64) ** 2, 9) AS weight FROM range(64)"),
}

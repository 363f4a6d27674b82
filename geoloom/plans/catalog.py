"""Queries of the label, source, sampling, export and integrity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import cleaning as C
from geoloom.operators import catalogue as CG
from geoloom.operators import dataset as D
from geoloom.operators import exports as E
from geoloom.operators import features as FT
from geoloom.operators import fetching as FE
from geoloom.operators import sampling as A
from geoloom.operators import splits as P
from geoloom.operators import targets as G
from geoloom.plans.patches import MEET, _SHARE, labels, patches, shapes
from geoloom.plans.tables import ANCHORS, FEATURES, PATCH, SCENES, anchors, features, scenes, sql, table

c = F.col


def raw_labels(spark, sf_dir) -> DataFrame:
    """Labels as they come: spaces, blanks, numbers with and without a point."""
    k = c("p_partkey")
    text = F.when(k % 17 == 0, "  ").when(k % 13 == 0, F.concat(c("p_size").cast("string"), F.lit(".0"))).when(k % 5 == 0, F.concat(F.lit(" "), c("p_size").cast("string"))).when(k % 7 == 0, F.concat(c("p_size").cast("string"), F.lit(".5"))).otherwise(F.concat(c("p_brand"), F.lit(" ")))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.alias("raw"))


RAW = "raw AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN '  ' WHEN p_partkey % 13 = 0 THEN p_size || '.0' WHEN p_partkey % 5 = 0 THEN ' ' || p_size WHEN p_partkey % 7 = 0 THEN p_size || '.5' ELSE p_brand || ' ' END AS raw FROM part)"
CLEAN = "clean AS (SELECT id, CASE WHEN trim(raw) = '' THEN NULL WHEN trim(raw) LIKE '%.0' THEN replace(trim(raw), '.0', '') ELSE trim(raw) END AS label FROM raw)"
ORDERED = "ordered AS (SELECT label, row_number() OVER (ORDER BY try_cast(label AS DOUBLE) IS NULL, coalesce(try_cast(label AS DOUBLE), 0), label) AS class_id FROM (SELECT DISTINCT label FROM clean WHERE label IS NOT NULL))"


def clean_labels(spark, sf_dir) -> DataFrame:
    return raw_labels(spark, sf_dir).select("id", C.normalised_label(c("raw")).alias("label"))


def l1_labels(spark, sf_dir) -> DataFrame:
    return clean_labels(spark, sf_dir)


def l2_label_order(spark, sf_dir) -> DataFrame:
    found = clean_labels(spark, sf_dir).select("label").where("label is not null").distinct()
    return found.select("label", F.row_number().over(Window.orderBy(C.label_order(c("label")))).cast("bigint").alias("place"))


def l3_class_ids(spark, sf_dir) -> DataFrame:
    df = clean_labels(spark, sf_dir)
    return df.join(F.broadcast(C.class_ids(df, "label")), "label", "left").select("id", F.coalesce("class_id", F.lit(0)).alias("class_id"))  # at most 255 labels


def l3_own_ids(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "part").select(c("p_size").cast("string").alias("label"))
    return C.class_ids(df, "label")


def l3_given_classes(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(c("c_mktsegment").alias("label"))
    return C.class_ids(df, "label", {"BUILDING": 1, "MACHINERY": 4})


def l4_skipped(spark, sf_dir) -> DataFrame:
    found = FT.skip_counts(clean_labels(spark, sf_dir), c("label"), F.rlike("label", F.lit(C.NUMBER)))
    return found.withColumnRenamed("unusable", "text")


def rings(spark, sf_dir) -> DataFrame:
    """Triangles in 0..360 longitudes, some with bad vertices."""
    k = c("s_suppkey")
    x, y = (k * 37) % 360 + 0.0, (k * 17) % 160 - 80.0
    wrap = lambda v: F.when(v >= 360, v - 360).otherwise(v)
    ring = F.array(*[F.struct(wrap(x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0.0, 0.0), (15.0, 5.0), (7.0, 14.0), (0.0, 0.0))])
    return table(spark, sf_dir, "supplier").select(k.alias("id"), ring.alias("ring"))


_CORNERS = "corners AS (SELECT id, i, CASE WHEN x + dx >= 360 THEN x + dx - 360 ELSE x + dx END AS x, y + dy AS y FROM (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 360 AS DOUBLE) AS x, CAST((s_suppkey * 17) % 160 - 80 AS DOUBLE) AS y FROM supplier), (VALUES (0, 0e0, 0e0), (1, 15e0, 5e0), (2, 7e0, 14e0), (3, 0e0, 0e0)) AS v(i, dx, dy))"


def l5_invalid(spark, sf_dir) -> DataFrame:
    return rings(spark, sf_dir).select("id", C.invalid_vertices(c("ring")).alias("invalid"))


def l15_bounds(spark, sf_dir) -> DataFrame:
    return rings(spark, sf_dir).select("id", FT.bounds(F.array(F.array("ring"))).alias("b")).select("id", "b.*")


def t25_jumps(spark, sf_dir) -> DataFrame:
    return rings(spark, sf_dir).select("id", C.jumps(c("ring")).alias("jumps"))


def t24_wrapped(spark, sf_dir) -> DataFrame:
    moved = rings(spark, sf_dir).select("id", C.wrapped_ring(c("ring")).alias("ring"))
    return moved.select("id", F.array_min(F.transform("ring", lambda p: p["x"])).alias("west"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("east"))


def l17_shared_classes(spark, sf_dir) -> DataFrame:
    """One numbering for the labels of two sets."""
    orders = table(spark, sf_dir, "orders")
    both = orders.select(c("o_orderpriority").alias("label")).unionByName(table(spark, sf_dir, "customer").select(c("c_mktsegment").alias("label")))
    return C.class_ids(both, "label")


def l21_closest_name(spark, sf_dir) -> DataFrame:
    """For each misspelt name the known one of least edit distance, then first by name."""
    nations = table(spark, sf_dir, "nation")
    known = [r[0] for r in nations.select("n_name").distinct().collect()]  # 25 nations, a list that a user would give
    return CG.closest(nations.select(F.concat(F.substring("n_name", 2, 20), F.lit("X")).alias("name")).distinct(), "name", known)


def s54_label_fields(spark, sf_dir) -> DataFrame:
    """Of each text column the five most frequent values, if it has at most 255."""
    return CG.label_fields(table(spark, sf_dir, "documents"), ["lang", "source", "text"])


def s5_failed_ratio(spark, sf_dir) -> DataFrame:
    """Sources whose share of failed fetches is over a limit."""
    return FE.failed_ratio(table(spark, sf_dir, "events"), ["user_id"], c("value") > 250, 0.02)


def s8_failures(spark, sf_dir) -> DataFrame:
    """Failures by kind with the first example, most frequent first."""
    return FE.failure_summary(table(spark, sf_dir, "events").where("value > 300"), "event_type", "event_id")


def s9_placeholders(spark, sf_dir) -> DataFrame:
    """Pages equal to a known placeholder by size and digest: here the short ones."""
    pages = table(spark, sf_dir, "pages")
    known = pages.select(F.octet_length("html").alias("size"), F.sha2(c("html").cast("binary"), 256).alias("sha256")).where("size < 1500")
    return FE.placeholders(pages, known, "html").select("page_id")


def s14_urls(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    templates = F.create_map(F.lit(0), F.lit("https://a.example/{z}/{x}/{y}.png"), F.lit(1), F.lit("https://b.example/tile?x={x}&y={y}&z={z}"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), C.tile_url(templates[k % 2], k * 3, k * 5, k % 19).alias("url"))


def responses(spark, sf_dir) -> DataFrame:
    e, v = c("event_id"), F.floor(c("value"))
    control = F.when(e % 7 == 0, "no-store").when(e % 7 == 1, F.concat(F.lit("public, max-age="), v.cast("string"))).when(e % 7 == 2, F.lit("max-age=oops")).when(e % 7 == 3, F.concat(F.lit("Max-Age=\""), (v * 100000).cast("string"), F.lit("\"")))
    return table(spark, sf_dir, "events").select(e.alias("id"), control.alias("control"), F.when(e % 7 == 4, v * 10 + 500).cast("double").alias("expires"), F.when(e % 2 == 0, 600.0).alias("date"), F.when(e % 3 == 0, (e % 90).cast("string")).when(e % 11 == 0, "x").alias("age"))


RESPONSES = "responses AS (SELECT event_id AS id, CAST(floor(value) AS BIGINT) AS v, event_id % 7 AS k, CASE WHEN event_id % 7 = 4 THEN CAST(floor(value) * 10 + 500 AS DOUBLE) END AS expires, CASE WHEN event_id % 2 = 0 THEN 600e0 END AS date, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 90 AS DOUBLE) ELSE 0e0 END AS age FROM events)"
FRESH = "fresh AS (SELECT id, CASE WHEN k = 0 THEN NULL WHEN k IN (5, 6) THEN 604800e0 WHEN l - age <= 0 THEN NULL ELSE least(l - age, 31536000e0) END AS seconds FROM (SELECT *, CASE k WHEN 1 THEN CAST(v AS DOUBLE) WHEN 2 THEN 0e0 WHEN 3 THEN CAST(v * 100000 AS DOUBLE) WHEN 4 THEN expires - coalesce(date, 900e0) END AS l FROM responses))"


def s16_freshness(spark, sf_dir) -> DataFrame:
    fresh = C.freshness(c("control"), c("expires"), c("date"), c("age"), F.lit(900.0))
    return responses(spark, sf_dir).select("id", fresh.alias("seconds"))


def s17_cache_usage(spark, sf_dir) -> DataFrame:
    return FE.cache_usage(s16_freshness(spark, sf_dir), "seconds", 300)


def s15_wanted_tiles(spark, sf_dir) -> DataFrame:
    """Wanted responses that no fresh one in the cache answers."""
    return FE.wanted(responses(spark, sf_dir).select("id"), s16_freshness(spark, sf_dir), ["id"], "seconds", 300)


def s18_kept_tiles(spark, sf_dir) -> DataFrame:
    return FE.fresh(s16_freshness(spark, sf_dir), "seconds", 300)


def s34_best_scene(spark, sf_dir) -> DataFrame:
    """Of each area the least cloudy scene under a limit, then the earliest, then the first id."""
    return CG.best_scene(scenes(spark, sf_dir), ["area"], 60)


def s33_intervals(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    text = F.when(k % 3 == 0, day).when(k % 3 == 1, F.concat(day, F.lit("/2025-01-31"))).otherwise(F.concat(day, F.lit("T01:02:03Z/.."))) 
    return table(spark, sf_dir, "supplier").select(k.alias("id"), C.rfc_interval(text).alias("interval"))


def ways(spark, sf_dir) -> DataFrame:
    k = c("o_orderkey")
    pair = lambda key, value: F.struct(F.lit(key).alias("k"), value.alias("v"))
    some = [pair("building", c("o_orderpriority")), F.when(k % 4 == 0, pair("highway", F.lit("path"))), F.when(k % 6 == 0, pair("area", F.lit("yes"))), F.when((k % 10 == 3) & (k % 6 != 0), pair("area", F.lit("no")))]
    tags = F.map_from_entries(F.array_compact(F.array(*some)))
    return table(spark, sf_dir, "orders").select(k.alias("id"), tags.alias("tags"), (k % 7).alias("n_coords"), (k % 5 != 0).alias("closed"))


def s37_tag_classes(spark, sf_dir) -> DataFrame:
    classes = [("road", {"highway": "*", "area": "*"}), ("urgent", {"building": ["1-URGENT", "2-HIGH"]}), ("path", {"highway": "path"}), ("low", {"building": "5-LOW"})]
    return ways(spark, sf_dir).select("id", C.tag_class(c("tags"), classes).alias("class"))


def s39_areas(spark, sf_dir) -> DataFrame:
    return ways(spark, sf_dir).select("id", C.is_area(c("n_coords"), c("closed"), c("tags")).alias("area"))


def s7_image_kinds(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    heads = F.array(*[F.lit(x) for x in (b"\x89PNG\r\n\x1a\nxx", b"\xff\xd8\xff\xe0xx", b"GIF89axx", b"RIFF0000WEBPxx", b"<html>")])
    return table(spark, sf_dir, "supplier").select(k.alias("id"), C.image_kind(F.get(heads, (k % 5).cast("int"))).alias("kind"))


def s55_digests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(c("html").cast("binary"), 256).alias("sha256"))


def rasters(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 37) % 300 + 1).alias("height"), ((k * 53) % 280 + 1).alias("width"))


RASTERS = "rasters AS (SELECT s_suppkey AS id, (s_suppkey * 37) % 300 + 1 AS height, (s_suppkey * 53) % 280 + 1 AS width FROM supplier)"


def a1_axis_counts(spark, sf_dir) -> DataFrame:
    p, s = F.lit(64).cast("bigint"), F.lit(48).cast("bigint")
    return rasters(spark, sf_dir).select("id", *[A.axis_count(c("height"), p, s, x).alias(f"n_{x}") for x in A.STRATEGIES])


def _grid(strategy: str):
    def query(spark, sf_dir) -> DataFrame:
        return A.grid(rasters(spark, sf_dir), 64, 48, strategy)

    return query


def a4_grid_counts(spark, sf_dir) -> DataFrame:
    p, s = F.lit(64).cast("bigint"), F.lit(48).cast("bigint")
    return rasters(spark, sf_dir).select("id", (A.axis_count(c("height"), p, s, "pad") * A.axis_count(c("width"), p, s, "pad")).alias("n"))


def a6_random_capacity(spark, sf_dir) -> DataFrame:
    return rasters(spark, sf_dir).select("id", *[A.random_capacity(c("height"), c("width"), F.lit(64), x).alias(f"n_{x}") for x in ("drop", "pad")])


def a7_random(spark, sf_dir) -> DataFrame:
    """A seeded random sample of at most 50 places of each raster, in its order."""
    return A.random_grid(rasters(spark, sf_dir).withColumn("seed", c("id") * 7 + 42), 64, 50)


def a16_clusters(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), ((c("s_suppkey") * 97) % 3400 * 10).alias("col"))
    return A.column_clusters(df, PATCH).select("id", c("cluster").cast("bigint").alias("cluster"))


def a17_chunks(spark, sf_dir) -> DataFrame:
    df = A.chunks(anchors(spark, sf_dir).select("id", "row", "col"), 512, 900, PATCH)
    return df.groupBy("chunk", "window").agg(F.count(F.lit(1)).alias("patches"), F.min("id").alias("first"), F.max("col").alias("last_col"))


def a20_remaining(spark, sf_dir) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_discount > 0.08").select(c("l_partkey").alias("id"))
    return A.remaining(anchors(spark, sf_dir).select("id"), done, ["id"])


def a22_broken_chunk(spark, sf_dir) -> DataFrame:
    """Patches to keep after a break: those of chunks before the first broken patch's."""
    df = anchors(spark, sf_dir).select("id", F.floor(c("row") / 512).alias("chunk"), "p_size", "p_brand")
    return D.before_break(df, (c("p_size") == 7) & (c("p_brand") == "Brand#33")).select("id", "chunk")


def a24_kept(spark, sf_dir) -> DataFrame:
    """What the keep rules do with each patch, the first that applies."""
    empty, share = (c("id") * 7) % 101 / 100.0, (c("id") * 13) % 100 / 100.0
    what = D.keep_reason(empty, share, 0.9, 0.1)
    return anchors(spark, sf_dir).groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("patches"))


def m12_plan(spark, sf_dir) -> DataFrame:
    """Patches, bytes and size class of each raster's job."""
    df = a4_grid_counts(spark, sf_dir).withColumn("bytes", c("n") * 64 * 64 * 3.0 * 1000)
    return df.select("id", "n", C.human_bytes(c("bytes")).alias("size"), C.size_category(c("n") * 1000).alias("category"), (c("bytes") > 2.5e8).alias("large"))


def objects(spark, sf_dir) -> DataFrame:
    return G.detections(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)


OBJECTS = f"objects AS (SELECT patch, feature, class_id, CAST(h0 - ac AS DOUBLE) AS x, CAST(v0 - ar AS DOUBLE) AS y, CAST(h1 - h0 AS DOUBLE) AS w, CAST(v1 - v0 AS DOUBLE) AS h, CAST((v1 - v0) * (h1 - h0) AS DOUBLE) AS area, (v1 - v0) * (h1 - h0) < area_all AS truncated FROM meet WHERE {_SHARE} AND v1 - v0 >= 2 AND h1 - h0 >= 2)"


def w8_coco(spark, sf_dir) -> DataFrame:
    return E.coco_annotations(objects(spark, sf_dir))


def w9_yolo(spark, sf_dir) -> DataFrame:
    return E.yolo_files(objects(spark, sf_dir), PATCH, PATCH)


def w10_yolo_indices(spark, sf_dir) -> DataFrame:
    return E.yolo_indices(labels(spark, sf_dir))


def w13_class_table(spark, sf_dir) -> DataFrame:
    found = objects(spark, sf_dir).groupBy(c("patch").alias("image")).agg(F.sort_array(F.collect_set("class_id")).alias("class_ids"))
    splits = P.random_split(patches(spark, sf_dir), "patch").select(c("patch").alias("image"), "split")
    names = features(spark, sf_dir).select("class_id", c("class_name").alias("name")).distinct()
    return E.class_table(found, splits, names)


def w15_footprints(spark, sf_dir) -> DataFrame:
    return E.footprints(patches(spark, sf_dir), (0.5, 0.0, 100.0, 0.0, -0.5, 900.0), PATCH)


def w18_shards(spark, sf_dir) -> DataFrame:
    samples = table(spark, sf_dir, "conversations").select(c("role").alias("split"), (c("conv_id") * 1000 + c("turn")).alias("ord"), E.tar_bytes(F.octet_length("text")).alias("size"))
    return E.shards(samples, 20_000)


def w21_split_codes(spark, sf_dir) -> DataFrame:
    df = P.random_split(patches(spark, sf_dir), "patch")
    return df.select("patch", E.split_code(F.when(c("row") < 2000, c("split"))).alias("code"))


def w23_manifest(spark, sf_dir) -> DataFrame:
    return D.manifest_lines(patches(spark, sf_dir).withColumn("name", c("patch")), ["name", "row", "col"])


def w30_strides(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), D.inference_stride(k % 60 + 4, (k % 5) / 8.0).alias("stride"))


def i1_verified(spark, sf_dir) -> DataFrame:
    """Listed files that are missing, and files that aren't listed: the parts of all order lines, and five that are no parts."""
    listed = anchors(spark, sf_dir).select((c("id") * 2).alias("id"))
    there = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("id")).distinct().unionByName(spark.range(5).select((c("id") + 10_000_000).alias("id")))
    return D.listed_problems(listed, there, "id")


def i6_mismatches(spark, sf_dir) -> DataFrame:
    """Fields of two runs' settings that differ, nulls equal."""
    a = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_size").cast("string").alias("x"), F.when(c("p_partkey") % 5 != 0, c("p_brand")).alias("y"))
    b = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), (c("p_size") - (c("p_partkey") % 3 == 0).cast("int")).cast("string").alias("x"), F.when(c("p_partkey") % 10 != 0, c("p_brand")).alias("y"))
    return D.mismatches(a, b, "id", ["x", "y"])


def i10_outside_paths(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    paths = F.array(*[F.lit(x) for x in ("Images/p.png", "/etc/x", "a/../b", "a//b", "./a", "C:\\x", "", "a/b..c")])
    return table(spark, sf_dir, "supplier").select(k.alias("id"), C.dataset_path(F.get(paths, (k % 8).cast("int"))).alias("inside"))


def i11_redacted(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.redacted_url(c("url")).alias("host"), C.redacted_query(F.concat(F.lit("https://user:pw@h.example/"), c("page_id").cast("string"), F.lit("?key=abc&x=1#f"))).alias("shown"))


def i12_internal(spark, sf_dir) -> DataFrame:
    k = c("c_custkey")
    ip = F.concat_ws(".", ((k * 7) % 256).cast("string"), ((k * 13) % 256).cast("string"), (k % 256).cast("string"), F.lit("9"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), C.internal_ip(ip).alias("internal"))


_DROP = "CASE WHEN {n} >= 64 THEN ({n} - 64) // 48 + 1 ELSE 0 END"
_SHIFT = "CASE WHEN {n} >= 64 THEN ({n} - 64) // 48 + 1 + CASE WHEN ({n} - 64) % 48 > 0 THEN 1 ELSE 0 END ELSE 1 END"
_PAD = "(({n} - 1) // 48 + 1)"


def _grid_sql(count: str, shift: bool = False) -> str:
    place = "greatest(0, least({i} * 48, {n} - 64))" if shift else "{i} * 48"
    r, k = place.format(i="i", n="height"), place.format(i="j", n="width")
    return sql(f"SELECT id, \"row\", col, \"row\" + 64 > height OR col + 64 > width AS padded FROM (SELECT id, height, width, {r} AS \"row\", {k} AS col FROM (SELECT *, unnest(range({count.format(n='width')})) AS j FROM (SELECT *, unnest(range({count.format(n='height')})) AS i FROM rasters)))", RASTERS)


_RING = [f"round(100 + (col + {u}) * 0.5e0, 9) AS x{i}, round(900 - (\"row\" + {v}) * 0.5e0, 9) AS y{i}" for i, (u, v) in enumerate([(0, 64), (64, 64), (64, 0), (0, 0), (0, 64)])]
_RANDOM = "split AS (SELECT id, CASE WHEN k <= ceil(n * 0.2e0) THEN 'test' WHEN k <= ceil(n * 0.2e0) + ceil((n - ceil(n * 0.2e0)) * 0.1e0) THEN 'val' ELSE 'train' END AS split FROM (SELECT id, row_number() OVER (ORDER BY md5('42:' || id)) AS k, count(*) OVER () AS n FROM anchors))"
_YOLO = "regexp_replace(regexp_replace(format('{{:.10f}}', least(greatest({v}, 0e0), 1e0)), '0+$', ''), '\\.$', '')"
_FOLD = """WITH RECURSIVE s AS (SELECT role AS split, conv_id * 1000 + turn AS ord, CAST(512 + ceil(strlen(text) / 512e0) * 512 AS BIGINT) AS size, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) AS k FROM conversations),
f AS (SELECT split, ord, size, k, 0::BIGINT AS shard, size AS held FROM s WHERE k = 1 UNION ALL SELECT s.split, s.ord, s.size, s.k, CASE WHEN held + s.size > 20000 THEN shard + 1 ELSE shard END, CASE WHEN held + s.size > 20000 THEN s.size ELSE held + s.size END FROM f JOIN s ON s.split = f.split AND s.k = f.k + 1)
SELECT split, ord, size, shard FROM f"""
_HUMAN = "CASE WHEN b < 1e3 THEN CAST(CAST(b AS BIGINT) AS VARCHAR) || ' B' WHEN b < 1e6 THEN format('{:.1f} KB', b / 1e3) WHEN b < 1e9 THEN format('{:.1f} MB', b / 1e6) WHEN b < 1e12 THEN format('{:.1f} GB', b / 1e9) ELSE format('{:.1f} TB', b / 1e12) END"
_IP = "(((c_custkey * 7) % 256) * 16777216 + ((c_custkey * 13) % 256) * 65536 + (c_custkey % 256) * 256 + 9)"
_NETS = [(127, 0, 8), (10, 0, 8), (172, 16, 12), (192, 168, 16), (169, 254, 16), (224, 0, 4), (100, 64, 10)]

QUERIES = {
    "l1_labels": (l1_labels, sql("SELECT id, label FROM clean", RAW, CLEAN)),
    "l2_label_order": (l2_label_order, sql("SELECT label, class_id AS place FROM ordered", RAW, CLEAN, ORDERED)),
    "l3_class_ids": (l3_class_ids, sql("SELECT id, coalesce(class_id, 0) AS class_id FROM clean LEFT JOIN ordered USING (label)", RAW, CLEAN, ORDERED)),
    "l3_own_ids": (l3_own_ids, "SELECT DISTINCT CAST(p_size AS VARCHAR) AS label, CAST(p_size AS BIGINT) AS class_id FROM part"),
    "l3_given_classes": (l3_given_classes, "SELECT DISTINCT c_mktsegment AS label, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 4 ELSE 0 END AS BIGINT) AS class_id FROM customer"),
    "l4_skipped": (l4_skipped, sql("SELECT count(*) FILTER (WHERE label IS NULL) AS without, count(*) FILTER (WHERE label IS NOT NULL AND try_cast(label AS DOUBLE) IS NULL) AS text, count(*) AS features FROM clean", RAW, CLEAN)),
    "l5_invalid": (l5_invalid, sql("SELECT id, bool_or(abs(y) > 90) AS invalid FROM corners GROUP BY id", _CORNERS)),
    "l15_bounds": (l15_bounds, sql("SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM corners GROUP BY id", _CORNERS)),
    "l17_shared_classes": (l17_shared_classes, "SELECT label, row_number() OVER (ORDER BY label) AS class_id FROM (SELECT o_orderpriority AS label FROM orders UNION SELECT c_mktsegment FROM customer)"),
    "l21_closest_name": (l21_closest_name, "SELECT name, known FROM (SELECT DISTINCT substr(n_name, 2, 20) || 'X' AS name FROM nation), (SELECT n_name AS known FROM nation) QUALIFY row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, known), known) = 1"),
    "t24_wrapped": (t24_wrapped, sql("SELECT id, CASE WHEN hi <= 180 THEN lo WHEN lo >= 180 THEN lo - 360 WHEN jump THEN mlo END AS west, CASE WHEN hi <= 180 THEN hi WHEN lo >= 180 THEN hi - 360 WHEN jump THEN mhi END AS east FROM (SELECT id, min(x) AS lo, max(x) AS hi, min(m) AS mlo, max(m) AS mhi, bool_or(d > 180 AND d < 360) AS jump FROM (SELECT id, x, CASE WHEN x > 180 THEN x - 360 ELSE x END AS m, abs(x - lag(x) OVER (PARTITION BY id ORDER BY i)) AS d FROM corners) GROUP BY id)", _CORNERS)),
    "t25_jumps": (t25_jumps, sql("SELECT id, bool_or(coalesce(d > 180 AND d < 360, false)) AS jumps FROM (SELECT id, abs(x - lag(x) OVER (PARTITION BY id ORDER BY i)) AS d FROM corners) GROUP BY id", _CORNERS)),
    "s5_failed_ratio": (s5_failed_ratio, "SELECT user_id, count(*) FILTER (WHERE value > 250) AS failed, count(*) AS total FROM events GROUP BY user_id HAVING failed / total > 0.02"),
    "s7_image_kinds": (s7_image_kinds, "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' END AS kind FROM supplier"),
    "s8_failures": (s8_failures, "SELECT event_type, n, example, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n, min(event_id) AS example FROM events WHERE value > 300 GROUP BY event_type)"),
    "s9_placeholders": (s9_placeholders, "SELECT page_id FROM pages WHERE sha256(html) IN (SELECT sha256(html) FROM pages WHERE strlen(html) < 1500)"),
    "s14_urls": (s14_urls, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'https://a.example/' || s_suppkey % 19 || '/' || s_suppkey * 3 || '/' || s_suppkey * 5 || '.png' ELSE 'https://b.example/tile?x=' || s_suppkey * 3 || '&y=' || s_suppkey * 5 || '&z=' || s_suppkey % 19 END AS url FROM supplier"),
    "s15_wanted_tiles": (s15_wanted_tiles, sql("SELECT id FROM fresh WHERE seconds IS NULL OR seconds <= 300", RESPONSES, FRESH)),
    "s16_freshness": (s16_freshness, sql("SELECT id, seconds FROM fresh", RESPONSES, FRESH)),
    "s17_cache_usage": (s17_cache_usage, sql("SELECT count(seconds) AS tiles, count(*) FILTER (WHERE seconds <= 300) AS expired, count(*) FILTER (WHERE seconds IS NULL) AS refused FROM fresh", RESPONSES, FRESH)),
    "s18_kept_tiles": (s18_kept_tiles, sql("SELECT id, seconds FROM fresh WHERE seconds > 300", RESPONSES, FRESH)),
    "s33_intervals": (s33_intervals, "SELECT id, CASE id % 3 WHEN 0 THEN d || 'T00:00:00Z/' || d || 'T23:59:59Z' WHEN 1 THEN d || 'T00:00:00Z/2025-01-31T23:59:59Z' ELSE d || 'T01:02:03Z/..' END AS \"interval\" FROM (SELECT s_suppkey AS id, strftime(DATE '2024-01-01' + CAST(s_suppkey % 300 AS INTEGER), '%Y-%m-%d') AS d FROM supplier)"),
    "s34_best_scene": (s34_best_scene, sql("SELECT area, arg_min(id, (cloud, taken, id)) AS id, count(*) AS candidates FROM scenes WHERE cloud <= 60 GROUP BY area", SCENES)),
    "s37_tag_classes": (s37_tag_classes, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 10 = 3) THEN 'road' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' WHEN o_orderkey % 4 = 0 THEN 'path' WHEN o_orderpriority = '5-LOW' THEN 'low' END AS \"class\" FROM orders"),
    "s39_areas": (s39_areas, "SELECT o_orderkey AS id, o_orderkey % 7 >= 4 AND o_orderkey % 5 <> 0 AND NOT ((o_orderkey % 10 = 3 OR o_orderkey % 4 = 0) AND o_orderkey % 6 <> 0) AS area FROM orders"),
    "s54_label_fields": (s54_label_fields, "SELECT field, value, n, \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS \"rank\", count(*) OVER (PARTITION BY field) AS kinds FROM (SELECT field, value, count(*) AS n FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents) WHERE value IS NOT NULL GROUP BY ALL)) WHERE kinds <= 255 AND \"rank\" <= 5"),
    "s55_digests": (s55_digests, "SELECT page_id, sha256(html) AS sha256 FROM pages"),
    "a1_axis_counts": (a1_axis_counts, sql(f"SELECT id, {_DROP.format(n='height')} AS n_drop, {_SHIFT.format(n='height')} AS n_shift, {_PAD.format(n='height')} AS n_pad FROM rasters", RASTERS)),
    "a3_grid_drop": (_grid("drop"), _grid_sql(_DROP)),
    "a3_grid_shift": (_grid("shift"), _grid_sql(_SHIFT, True)),
    "a3_grid_pad": (_grid("pad"), _grid_sql(_PAD)),
    "a4_grid_counts": (a4_grid_counts, sql(f"SELECT id, {_PAD.format(n='height')} * {_PAD.format(n='width')} AS n FROM rasters", RASTERS)),
    "a6_random_capacity": (a6_random_capacity, sql("SELECT id, CASE WHEN height >= 64 AND width >= 64 THEN (height - 63) * (width - 63) ELSE 0 END AS n_drop, greatest(height - 63, 1) * greatest(width - 63, 1) AS n_pad FROM rasters", RASTERS)),
    "a7_random": (a7_random, None),
    "a16_clusters": (a16_clusters, sql("SELECT id, cluster FROM places JOIN (SELECT col, CAST(sum(s) OVER (ORDER BY col) AS BIGINT) AS cluster FROM (SELECT col, CASE WHEN col - lag(col) OVER (ORDER BY col) > 128 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT col FROM places))) USING (col)", "places AS (SELECT s_suppkey AS id, (s_suppkey * 97) % 3400 * 10 AS col FROM supplier)")),
    "a17_chunks": (a17_chunks, sql("SELECT \"row\" // 512 AS chunk, (col - first_col) // 836 AS \"window\", count(*) AS patches, min(id) AS \"first\", max(col) AS last_col FROM (SELECT *, min(col) OVER (PARTITION BY \"row\" // 512) AS first_col FROM anchors) GROUP BY 1, 2", ANCHORS)),
    "a20_remaining": (a20_remaining, sql("SELECT id FROM anchors WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)", ANCHORS)),
    "a22_broken_chunk": (a22_broken_chunk, sql("SELECT id, \"row\" // 512 AS chunk FROM anchors WHERE \"row\" // 512 < coalesce((SELECT min(\"row\" // 512) FROM anchors WHERE p_size = 7 AND p_brand = 'Brand#33'), 1000000000)", ANCHORS)),
    "a24_kept": (a24_kept, sql("SELECT CASE WHEN (id * 7) % 101 >= 100 THEN 'no imagery' WHEN (id * 7) % 101 > 90 THEN 'too empty' WHEN (id * 13) % 100 < 10 THEN 'too few labels' ELSE 'kept' END AS what, count(*) AS patches FROM anchors GROUP BY 1", ANCHORS)),
    "m12_plan": (m12_plan, sql(f"SELECT id, n, {_HUMAN} AS size, CASE WHEN n * 1000 < 1000 THEN 'n<1K' WHEN n * 1000 < 10000 THEN '1K<n<10K' WHEN n * 1000 < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END AS category, b > 2.5e8 AS large FROM (SELECT *, n * 64 * 64 * 3e0 * 1000 AS b FROM (SELECT id, {_PAD.format(n='height')} * {_PAD.format(n='width')} AS n FROM rasters))", RASTERS)),
    "w8_coco": (w8_coco, sql("SELECT row_number() OVER (ORDER BY patch, feature) AS id, patch + 1 AS image_id, class_id AS category_id, x, y, w, h, area, truncated FROM objects", ANCHORS, FEATURES, MEET, OBJECTS)),
    "w9_yolo": (w9_yolo, sql("SELECT patch, string_agg(CAST(class_id - 1 AS VARCHAR) || ' ' || " + " || ' ' || ".join(_YOLO.format(v=v) for v in ("(x + w / 2) / 64", "(y + h / 2) / 64", "w / 64", "h / 64")) + ", chr(10) ORDER BY feature) AS text FROM objects GROUP BY patch", ANCHORS, FEATURES, MEET, OBJECTS)),
    "w10_yolo_indices": (w10_yolo_indices, sql("SELECT class_id, row_number() OVER (ORDER BY class_id) - 1 AS \"index\" FROM (SELECT DISTINCT class_id FROM features)", FEATURES)),
    "w13_class_table": (w13_class_table, sql("SELECT patch AS image, labels, split FROM (SELECT patch, string_agg(class_name, ' ' ORDER BY class_id) AS labels FROM (SELECT DISTINCT patch, o.class_id, class_name FROM objects o JOIN features f ON f.id = o.feature) GROUP BY patch) JOIN split ON id = patch", ANCHORS, FEATURES, MEET, OBJECTS, _RANDOM)),
    "w15_footprints": (w15_footprints, sql("SELECT id AS patch, " + ", ".join(_RING) + " FROM anchors", ANCHORS)),
    "w18_shards": (w18_shards, _FOLD),
    "w21_split_codes": (w21_split_codes, sql("SELECT id AS patch, CAST(CASE WHEN \"row\" >= 2000 THEN 255 WHEN split = 'train' THEN 0 WHEN split = 'val' THEN 1 ELSE 2 END AS BIGINT) AS code FROM split JOIN anchors USING (id)", ANCHORS, _RANDOM)),
    "w23_manifest": (w23_manifest, sql("SELECT id AS patch, '{\"name\":' || id || ',\"row\":' || \"row\" || ',\"col\":' || col || '}' AS line FROM anchors", ANCHORS)),
    "w30_strides": (w30_strides, "SELECT s_suppkey AS id, greatest(1, CAST(round_even((s_suppkey % 60 + 4) * (1 - (s_suppkey % 5) / 8e0), 0) AS BIGINT)) AS stride FROM supplier"),
    "i1_verified": (i1_verified, "WITH listed AS (SELECT p_partkey * 2 AS id FROM part), there AS (SELECT DISTINCT l_partkey AS id FROM lineitem UNION ALL SELECT 10000000 + range FROM range(5)) SELECT id, 'missing' AS problem FROM listed WHERE id NOT IN (SELECT id FROM there) UNION ALL SELECT id, 'unlisted' FROM there WHERE id NOT IN (SELECT id FROM listed)"),
    "i6_mismatches": (i6_mismatches, "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 10 = 5 THEN 'x,y' WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'y' END AS fields FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 10 = 5"),
    "i10_outside_paths": (i10_outside_paths, "SELECT s_suppkey AS id, s_suppkey % 8 IN (0, 7) AS inside FROM supplier"),
    "i11_redacted": (i11_redacted, "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) || '://' || regexp_extract(url, '^(https?)://([^/]+)', 2) || '/...' AS host, 'https://h.example/' || page_id || '?key=***&x=***#f' AS shown FROM pages"),
    "i12_internal": (i12_internal, f"SELECT c_custkey AS id, " + " OR ".join(f"{_IP} BETWEEN {a * 2**24 + b * 2**16} AND {a * 2**24 + b * 2**16 + 2 ** (32 - n) - 1}" for a, b, n in _NETS) + " AS internal FROM customer"),
}

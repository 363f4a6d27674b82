"""Further queries: reprojection, stacks, label sets, chunk order, padding, tables and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import cleaning as C
from geoloom.functions import tiles as T
from geoloom.functions import utm
from geoloom.operators import alignment as AL
from geoloom.operators import burn as B
from geoloom.operators import catalogue as CG
from geoloom.operators import dataset as D
from geoloom.operators import exports as E
from geoloom.operators import features as FT
from geoloom.operators import fetching as FE
from geoloom.operators import raster as R
from geoloom.operators import sampling as A
from geoloom.operators import spatial as S
from geoloom.operators import splits as P
from geoloom.operators import targets as G
from geoloom.plans.geometry import _POINT_TILE
from geoloom.plans.masks import PIXELS, pixels
from geoloom.plans.patches import BURNED, IN_PATCH, MEET, _SHARE, g18_class_pixels, labels, patches, shapes, valid_patches
from geoloom.plans.tables import ANCHORS, FEATURES, PATCH, POINTS, anchors, points, sql, table

c = F.col


def t27_rings_to_mercator(spark, sf_dir) -> DataFrame:
    """Rings in map units, latitudes cut at the square world's edge."""
    k = c("s_suppkey")
    lat = (k * 17) % 200 - 100.0
    ring = F.array(*[F.struct(((k * 37) % 350 - 180.0 + dx).alias("lon"), (lat + dy).alias("lat")) for dx, dy in ((0, 0), (5, 0), (5, 5))])
    cut = F.transform(ring, lambda p: T.mercator(p["lon"], T.clamp(p["lat"], -T.MERCATOR_MAX_LATITUDE, T.MERCATOR_MAX_LATITUDE)))
    df = table(spark, sf_dir, "supplier").select(k.alias("id"), F.posexplode(cut).alias("i", "p"))
    return df.select("id", c("i").cast("bigint").alias("i"), F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


def t28_utm_round_trip(spark, sf_dir) -> DataFrame:
    """Positions through their UTM zone and back."""
    df = points(spark, sf_dir).where("abs(lat) <= 84").withColumn("epsg", T.utm_epsg(c("lon"), c("lat")))
    df = df.withColumn("m", utm.to_utm(c("lon"), c("lat"), c("epsg"))).withColumn("b", utm.from_utm(c("m.x"), c("m.y"), c("epsg")))
    return df.select("id", (c("m.x").between(160000, 840000)).alias("in_zone"), F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))


def s6_retry_delays(spark, sf_dir) -> DataFrame:
    """Waits before the next try: what the server asks for, at most 30 s, else longer with each try."""
    asked = F.when(c("event_id") % 3 == 0, F.floor("value"))
    return table(spark, sf_dir, "events").select("event_id", FE.retry_seconds(c("event_id") % 4, asked).cast("bigint").alias("seconds"))


def s12_stitch_offsets(spark, sf_dir) -> DataFrame:
    """Where each tile of a set lies on the canvas of its zoom, in pixels."""
    df = points(spark, sf_dir).withColumn("t", T.tile(c("lon"), c("lat"), c("zoom"))).select("zoom", c("t.x").alias("x"), c("t.y").alias("y")).distinct()
    least = df.groupBy("zoom").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return df.join(F.broadcast(least), "zoom").select("zoom", "x", "y", ((c("x") - c("x0")) * 256).alias("left"), ((c("y") - c("y0")) * 256).alias("top"))  # at most 33 zooms


def s30_cloud_masked(spark, sf_dir) -> DataFrame:
    """Bands of several sources at one pixel; scene classes of clouds and shadows, or beyond the known, are no data."""
    rows = table(spark, sf_dir, "lineitem")
    stack = rows.groupBy(c("l_partkey").alias("pixel")).agg((F.max_by("l_linenumber", F.struct("l_shipdate", "l_orderkey")).cast("bigint") * 2).alias("scl"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return CG.cloud_masked(stack, "scl", ["low", "high"]).select("pixel", "valid", "low", "high")


def s36_tag_queries(spark, sf_dir) -> DataFrame:
    """Selector text for each nation's tag in a box."""
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    selector = F.when(c("n_regionkey") == 0, F.concat(F.lit('["'), name, F.lit('"]'))).otherwise(F.concat(F.lit('["place"="'), name, F.lit('"]')))
    return table(spark, sf_dir, "nation").select(c("n_nationkey").cast("bigint").alias("id"), CG.tag_query(selector, *[c("n_nationkey") + i for i in range(4)]).alias("text"))


def s38_ordered_features(spark, sf_dir) -> DataFrame:
    """Elements of a map answer in the order that decides which lies on top: class, then type, then id."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return CG.ordered_features(rows, "o_orderpriority", "o_orderstatus", "o_orderkey").select(c("o_orderkey").alias("id"), "place")


def l6_projected(spark, sf_dir) -> DataFrame:
    """Nations whose customers' coordinates can't be degrees."""
    x = F.when(c("c_custkey") % 190 == 3, 500000.0).otherwise(c("c_custkey") % 360 - 180.0)
    parts = F.array(F.array(F.array(F.struct(x.alias("x"), F.lit(0.0).alias("y")))))
    return table(spark, sf_dir, "customer").groupBy(c("c_nationkey").cast("bigint").alias("nation")).agg(F.bool_or(FT.projected(parts)).alias("projected"))


def l10_zone_pieces(spark, sf_dir) -> DataFrame:
    """UTM zones that boxes reach into, with the part of the box in each."""
    k = c("s_suppkey")
    west = (k * 97) % 340 - 170.0
    df = table(spark, sf_dir, "supplier").select(k.alias("id"), west.alias("west"), (west + (k % 20) / 2.0 + 0.5).alias("east"))
    return FT.zone_pieces(df).select("id", "zone", "west", "east")


def l11_union(spark, sf_dir) -> DataFrame:
    """Two label sets in one order, the second on top, numbered together."""
    a = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("label"))
    b = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), F.when(c("s_suppkey") % 2 == 0, "BUILDING").otherwise("TOWER").alias("label"))
    both = FT.united([a, b])
    return FT.kept(both, C.class_ids(both, "label"), "label").select("file", "id", "class_id")


def l13_ignore_clash(spark, sf_dir) -> DataFrame:
    """Classes with the number that means "not labelled"."""
    ids = C.class_ids(table(spark, sf_dir, "part").select(c("p_size").cast("string").alias("label")), "label")
    return ids.where(c("class_id") == 37).select("label", "class_id")


def l18_shared_lookup(spark, sf_dir) -> DataFrame:
    """Own class numbers to those shared by two sets."""
    own = C.class_ids(table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("label")), "label").withColumnRenamed("class_id", "own")
    both = table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("label")).unionByName(table(spark, sf_dir, "customer").select(c("c_mktsegment").alias("label")))
    return own.join(F.broadcast(C.class_ids(both, "label").withColumnRenamed("class_id", "shared")), "label").select("own", "shared")


def l20_areas(spark, sf_dir) -> DataFrame:
    """Named areas: how many pieces and how much area each has."""
    df = FT.area_names(labels(spark, sf_dir), "class_name")
    return df.groupBy(c("class_name").alias("name")).agg(F.count(F.lit(1)).alias("pieces"), F.sum((c("r1") - c("r0")) * (c("c1") - c("c0"))).alias("area"))


def a10_position_order(spark, sf_dir) -> DataFrame:
    """Sampled positions by row strip, in the sampled order within each."""
    df = D.by_strip(anchors(spark, sf_dir).select("id", "row"), 512, F.struct((c("id") * 7919) % 10007, "id"))
    return df.select("id", "place", "strip")


def a19_large_chunks(spark, sf_dir) -> DataFrame:
    """Strips with more patches than one may hold."""
    df = A.chunks(anchors(spark, sf_dir).select("id", "row", "col"), 512, 900, PATCH)
    return df.groupBy("chunk").agg(F.count(F.lit(1)).alias("patches")).where("patches > 300")


def a21_completed(spark, sf_dir) -> DataFrame:
    """Distinct positions that are done, as one number each."""
    done = table(spark, sf_dir, "lineitem").select((c("l_partkey") % 70).alias("row"), (c("l_suppkey") % 90).alias("col"))
    return D.completed(done).select((c("row") * 1000 + c("col")).alias("pos"))


def r3_valid_everywhere(spark, sf_dir) -> DataFrame:
    """Pixels that every source has."""
    return AL.valid_everywhere(table(spark, sf_dir, "lineitem").withColumn("pixel", c("l_partkey")), ["pixel"], c("l_tax") < 0.08)


def r4_stackable(spark, sf_dir) -> DataFrame:
    """Groups of sources whose bands and types agree."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey"))
    s = s.select(c("n_name").alias("stack"), (c("s_suppkey") % 3).alias("bands"), F.when(c("s_acctbal") > 5000, "uint16").otherwise("uint8").alias("dtype"))
    return AL.stackable(s, ["stack"], "bands", "dtype")


def r12_any_overlap(spark, sf_dir) -> DataFrame:
    """Classes with a label in the raster's first quarter."""
    return AL.any_overlap(labels(spark, sf_dir), ["class_id"], 600, 600)


def g2_padded_masks(spark, sf_dir) -> DataFrame:
    """Pixels of each patch beyond the raster's edge, which the mask ignores, and those inside."""
    counts = G.class_pixels(valid_patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)
    ignored = F.coalesce(F.sum(F.when(c("class_id") == G.IGNORE, c("pixels"))), F.lit(0))
    return counts.groupBy("patch").agg((F.sum("pixels") - ignored).alias("inside"), ignored.alias("ignored"))


def g9_accepts_instances(spark, sf_dir) -> DataFrame:
    """Patches that instances cover by a twentieth or more, each pixel once."""
    found = B.feature_pixels(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH).groupBy("patch").agg(F.sum("pixels").alias("covered"))
    return found.where(c("covered") >= 0.05 * PATCH * PATCH)


def g11_accepts_classes(spark, sf_dir) -> DataFrame:
    return G.labelled(g18_class_pixels(spark, sf_dir), PATCH, 0.1).select("patch")


def g13_padded_values(spark, sf_dir) -> DataFrame:
    """Rows of a continuous target beyond the edge are not-a-number: what is left of each patch."""
    rows = AL.padded_values(pixels(spark, sf_dir), c("r") + c("id") % 4 < 8, "v")
    return rows.groupBy("id").agg(F.count_if(~F.isnan("v")).alias("valid"), F.round(F.sum(F.when(~F.isnan("v"), c("v"))), 6).alias("total"))


def m3_valid_pixels(spark, sf_dir) -> DataFrame:
    """Pixels whose bands are finite and not all black."""
    level = F.round("v", 1) + 0.0
    bands = pixels(spark, sf_dir).groupBy("id", "r", F.floor(c("c") / 2).alias("p")).agg(F.min_by(level, "c").alias("a"), F.max_by(level, "c").alias("b"))
    return D.valid_pixels(bands, ["id"], [c("a"), c("b")], black_is_empty=True)


def _statistics(spark, sf_dir, split: str) -> tuple[DataFrame, DataFrame]:
    rows = pixels(spark, sf_dir).withColumnRenamed("id", "patch")
    split_of = P.random_split(rows.select("patch").distinct(), "patch")
    return D.statistics(rows.withColumn("band", F.lit(0)), R.histogram(rows, ["patch"]), split_of, split, value="v")


def m6_split_statistics(spark, sf_dir) -> DataFrame:
    """Moments of the training patches alone."""
    return _statistics(spark, sf_dir, "train")[0].select("count", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def m7_class_statistics(spark, sf_dir) -> DataFrame:
    """Classes of the training patches: pixels, patches, frequency and weight."""
    found = _statistics(spark, sf_dir, "train")[1]
    return found.select("class_id", "pixels", "patches", F.round("frequency", 9).alias("frequency"), F.round("weight", 8).alias("weight"))


def m9_info_table(spark, sf_dir) -> DataFrame:
    """Objects by split and class, with totals of either."""
    found = G.detections(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH).join(P.random_split(patches(spark, sf_dir), "patch").select("patch", "split"), "patch")
    return found.rollup("split", "class_id").agg(F.count(F.lit(1)).alias("objects"), F.round(F.sum("area"), 2).alias("area"))


def w12_coco_instances(spark, sf_dir) -> DataFrame:
    """Instances with ids over all patches and the run lengths of their masks."""
    found = G.instances(patches(spark, sf_dir), shapes(spark, sf_dir), PATCH)
    return E.numbered(found).select("id", "patch", "class_id", F.array_join(c("counts").cast("array<string>"), ",").alias("counts"))


def w16_by_split(spark, sf_dir) -> DataFrame:
    """Rows that each split's file gets."""
    df = P.stratified_split(anchors(spark, sf_dir).select("id", c("p_brand").alias("stratum")), "id", ["stratum"])
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"), F.sum("id").alias("ids"))


def w19_sample_json(spark, sf_dir) -> DataFrame:
    df = P.random_split(patches(spark, sf_dir), "patch")
    record = F.to_json(F.struct("col", c("patch").alias("name"), "row", "split"))
    return df.select("patch", record.alias("json"))


def w25_checksums(spark, sf_dir) -> DataFrame:
    """Lines of a checksum file."""
    return D.checksum_lines(table(spark, sf_dir, "documents"), F.concat(F.lit("docs/"), c("doc_id").cast("string")), "text", "doc_id")


def i4_mask_check(spark, sf_dir) -> DataFrame:
    """Patches whose recorded histogram isn't that of their mask."""
    real = R.histogram(pixels(spark, sf_dir), ["id", "label"])
    noted = real.withColumn("pixels", c("pixels") + F.when((c("label") == 3) & (c("class_id") == 1), 1).otherwise(0)).drop("label")
    both = real.alias("a").join(noted.alias("b"), ["id", "class_id"], "full")
    return both.where(~c("a.pixels").eqNullSafe(c("b.pixels"))).select("id").distinct()


def i8_upgraded(spark, sf_dir) -> DataFrame:
    """Old entries as new ones: their places, files, strip and counts."""
    k = c("p_partkey")
    counts = F.create_map(F.lit("0"), c("p_size"), F.lit("3"), (k % 60).cast("int"))
    mask = F.when(k % 3 != 0, F.format_string("mask_%07d.png", k))
    old = table(spark, sf_dir, "part").select(F.format_string("patch_%07d.png", k).alias("filename"), mask.alias("mask_filename"), (k % 40).alias("row"), k.alias("col"), F.when(k % 2 == 0, F.lit(True)).alias("padded"), (k % 7).alias("strip_index"), counts.alias("per_class_pixel_counts"), (k % 10 / 10.0).alias("empty_ratio"))
    pixels = F.aggregate(F.map_values("summary.class_pixels"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return D.upgraded(old).select(c("col").alias("id"), "row", "padded", "chunk", F.array_join(F.sort_array(F.map_values("files")), ",").alias("files"), pixels.alias("pixels"), c("summary.empty_ratio").alias("empty_ratio"))


def d16_stacks(spark, sf_dir) -> DataFrame:
    """Values of several dates at each pixel in order of date."""
    rows = table(spark, sf_dir, "lineitem")
    found = rows.groupBy(c("l_partkey").alias("pixel")).agg(F.sort_array(F.collect_list(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"))).alias("s"))
    return found.select("pixel", F.array_join(F.transform("s", lambda x: x["l_quantity"].cast("bigint").cast("string")), ",").alias("stack"))


def s58_loaded(spark, sf_dir) -> DataFrame:
    """Normalised patches of one split."""
    rows = pixels(spark, sf_dir)
    split = P.random_split(rows.select("id").distinct(), "id").where("split = 'val'").select("id")
    stats = R.moments(rows.withColumn("k", F.lit(0)), ["k"], "v").select("mean", "std")
    return rows.join(split, "id", "left_semi").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.round(F.avg((c("v") - c("mean")) / c("std")), 7).alias("mean"))


_SPLIT_OF = "split AS (SELECT id, CASE WHEN k <= ceil(n * 0.2e0) THEN 'test' WHEN k <= ceil(n * 0.2e0) + ceil((n - ceil(n * 0.2e0)) * 0.1e0) THEN 'val' ELSE 'train' END AS split FROM (SELECT id, row_number() OVER ({by} ORDER BY md5('42:' || id)) AS k, count(*) OVER ({by}) AS n FROM {rows}))"
_OBJECTS = f"objects AS (SELECT * FROM meet WHERE {_SHARE} AND v1 - v0 >= 2 AND h1 - h0 >= 2)"
_CELLS = f"""SELECT row_number() OVER (ORDER BY patch, feature) AS id, patch, class_id, CASE WHEN h = {PATCH} THEN b || ',' || w * {PATCH} ELSE b || ',' || CASE WHEN w > 1 THEN repeat(h || ',' || {PATCH} - h || ',', CAST(w - 1 AS BIGINT)) ELSE '' END || h END || CASE WHEN t > 0 THEN ',' || t ELSE '' END AS counts
FROM (SELECT *, x * {PATCH} + y AS b, {PATCH * PATCH} - (x * {PATCH} + y) - (w - 1) * {PATCH} - h AS t FROM (SELECT patch, feature, class_id, h0 - ac AS x, v0 - ar AS y, h1 - h0 AS w, v1 - v0 AS h FROM meet WHERE {_SHARE} AND (v1 - v0) * (h1 - h0) >= 4))"""

QUERIES = {
    "t27_rings_to_mercator": (t27_rings_to_mercator, "SELECT id, CAST(i AS BIGINT) AS i, round(6378137 * radians(lon), 2) AS x, round(6378137 * ln(tan(pi() / 4 + radians(least(greatest(lat, -85.05112878e0), 85.05112878e0)) / 2)), 2) AS y FROM (SELECT s_suppkey AS id, i, CAST((s_suppkey * 37) % 350 - 180 + dx AS DOUBLE) AS lon, CAST((s_suppkey * 17) % 200 - 100 + dy AS DOUBLE) AS lat FROM supplier, (VALUES (0, 0, 0), (1, 5, 0), (2, 5, 5)) AS v(i, dx, dy))"),
    "t28_utm_round_trip": (t28_utm_round_trip, sql("SELECT id, true AS in_zone, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points WHERE abs(lat) <= 84", POINTS)),
    "s6_retry_delays": (s6_retry_delays, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(CAST(floor(value) AS BIGINT), 30) ELSE event_id % 4 + 1 END AS seconds FROM events"),
    "s30_cloud_masked": (s30_cloud_masked, "SELECT pixel, ok AS valid, CASE WHEN ok THEN low END AS low, CASE WHEN ok THEN high END AS high FROM (SELECT *, scl NOT IN (3, 8, 9, 10) AND scl <= 11 AS ok FROM (SELECT l_partkey AS pixel, arg_max(l_linenumber, (l_shipdate, l_orderkey)) * 2 AS scl, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_partkey))"),
    "s36_tag_queries": (s36_tag_queries, "SELECT CAST(n_nationkey AS BIGINT) AS id, 'nwr' || CASE WHEN n_regionkey = 0 THEN '[\"' || lower(replace(n_name, ' ', '_')) || '\"]' ELSE '[\"place\"=\"' || lower(replace(n_name, ' ', '_')) || '\"]' END || '(' || n_nationkey || ',' || n_nationkey + 1 || ',' || n_nationkey + 2 || ',' || n_nationkey + 3 || ');' AS text FROM nation"),
    "s38_ordered_features": (s38_ordered_features, "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus, o_orderkey) AS place FROM orders"),
    "l6_projected": (l6_projected, "SELECT CAST(c_nationkey AS BIGINT) AS nation, bool_or(c_custkey % 190 = 3) AS projected FROM customer GROUP BY c_nationkey"),
    "l10_zone_pieces": (l10_zone_pieces, "SELECT id, zone, greatest(west, zone * 6 - 186e0) AS west, least(east, zone * 6 - 180e0) AS east FROM (SELECT id, west, east, unnest(range(CAST(floor((west + 180) / 6) + 1 AS BIGINT), CAST(floor((east + 180) / 6) + 2 AS BIGINT))) AS zone FROM (SELECT s_suppkey AS id, CAST((s_suppkey * 97) % 340 - 170 AS DOUBLE) AS west, (s_suppkey * 97) % 340 - 170 + (s_suppkey % 20) / 2e0 + 0.5e0 AS east FROM supplier)) WHERE least(east, zone * 6 - 180e0) > greatest(west, zone * 6 - 186e0)"),
    "l11_union": (l11_union, "WITH b AS (SELECT 0::BIGINT AS file, c_custkey AS id, c_mktsegment AS label FROM customer UNION ALL SELECT 1, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'TOWER' END FROM supplier) SELECT file, id, dense_rank() OVER (ORDER BY label) AS class_id FROM b"),
    "l13_ignore_clash": (l13_ignore_clash, "SELECT DISTINCT CAST(p_size AS VARCHAR) AS label, CAST(p_size AS BIGINT) AS class_id FROM part WHERE p_size = 37"),
    "l18_shared_lookup": (l18_shared_lookup, "SELECT own, shared FROM (SELECT label, row_number() OVER (ORDER BY label) AS own FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)) JOIN (SELECT label, row_number() OVER (ORDER BY label) AS shared FROM (SELECT o_orderpriority AS label FROM orders UNION SELECT c_mktsegment FROM customer)) USING (label)"),
    "l20_areas": (l20_areas, sql("SELECT class_name AS name, count(*) AS pieces, CAST(sum((r1 - r0) * (c1 - c0)) AS BIGINT) AS area FROM features GROUP BY class_name", FEATURES)),
    "a10_position_order": (a10_position_order, sql("SELECT id, row_number() OVER (PARTITION BY \"row\" // 512 ORDER BY (id * 7919) % 10007, id) AS place, \"row\" // 512 AS strip FROM anchors", ANCHORS)),
    "a19_large_chunks": (a19_large_chunks, sql("SELECT \"row\" // 512 AS chunk, count(*) AS patches FROM anchors GROUP BY 1 HAVING count(*) > 300", ANCHORS)),
    "a21_completed": (a21_completed, "SELECT DISTINCT (l_partkey % 70) * 1000 + l_suppkey % 90 AS pos FROM lineitem"),
    "r3_valid_everywhere": (r3_valid_everywhere, "SELECT l_partkey AS pixel, bool_and(l_tax < 0.08) AS valid FROM lineitem GROUP BY l_partkey"),
    "r4_stackable": (r4_stackable, "SELECT n_name AS stack, count(DISTINCT (s_suppkey % 3) || CASE WHEN s_acctbal > 5000 THEN 'uint16' ELSE 'uint8' END) = 1 AS stackable, count(*) AS sources FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "r12_any_overlap": (r12_any_overlap, sql("SELECT class_id, bool_or(r0 < 600 AND c0 < 600) AS overlaps FROM features GROUP BY class_id", FEATURES)),
    "g2_padded_masks": (g2_padded_masks, sql(f"SELECT id AS patch, n AS inside, {PATCH * PATCH} - n AS ignored FROM (SELECT id, greatest(0, least(\"row\" + {PATCH}, 2500) - \"row\") * greatest(0, least(col + {PATCH}, 2380) - col) AS n FROM anchors)", ANCHORS)),
    "g9_accepts_instances": (g9_accepts_instances, sql(f"SELECT patch, count(*) AS covered FROM inpatch GROUP BY patch HAVING count(*) >= {0.05 * PATCH * PATCH}", ANCHORS, FEATURES, BURNED, IN_PATCH)),
    "g11_accepts_classes": (g11_accepts_classes, sql(f"SELECT patch FROM inpatch GROUP BY patch HAVING count(*) >= {0.1 * PATCH * PATCH}", ANCHORS, FEATURES, BURNED, IN_PATCH)),
    "g13_padded_values": (g13_padded_values, sql("SELECT id, count(*) AS valid, round(sum(v), 6) AS total FROM pixels WHERE r + id % 4 < 8 GROUP BY id", PIXELS)),
    "m3_valid_pixels": (m3_valid_pixels, sql("SELECT id, count(*) FILTER (WHERE m > 0) AS valid FROM (SELECT id, r, c // 2 AS p, max(abs(round(v, 1))) AS m FROM pixels GROUP BY ALL) GROUP BY id", PIXELS)),
    "m6_split_statistics": (m6_split_statistics, sql("SELECT count(v) AS count, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std FROM pixels WHERE id IN (SELECT id FROM split WHERE split = 'train')", PIXELS, _SPLIT_OF.format(by="", rows="(SELECT DISTINCT id FROM pixels)"))),
    "m9_info_table": (m9_info_table, sql("SELECT split, class_id, count(*) AS objects, round(sum((v1 - v0) * (h1 - h0)) * 1e0, 2) AS area FROM objects JOIN split ON id = patch GROUP BY ROLLUP (split, class_id)", ANCHORS, FEATURES, MEET, _OBJECTS, _SPLIT_OF.format(by="", rows="anchors"))),
    "s12_stitch_offsets": (s12_stitch_offsets, sql("SELECT zoom, x, y, (x - min(x) OVER (PARTITION BY zoom)) * 256 AS \"left\", (y - min(y) OVER (PARTITION BY zoom)) * 256 AS top FROM (SELECT DISTINCT zoom, x, y FROM tiles)", POINTS, _POINT_TILE)),
    "w12_coco_instances": (w12_coco_instances, sql(_CELLS, ANCHORS, FEATURES, MEET)),
    "w16_by_split": (w16_by_split, sql("SELECT split, count(*) AS \"rows\", min(id) AS \"first\", CAST(sum(id) AS BIGINT) AS ids FROM split GROUP BY split", ANCHORS, _SPLIT_OF.format(by="PARTITION BY p_brand", rows="anchors"))),
    "w19_sample_json": (w19_sample_json, sql("SELECT id AS patch, '{\"col\":' || col || ',\"name\":' || id || ',\"row\":' || \"row\" || ',\"split\":\"' || split || '\"}' AS json FROM anchors JOIN split USING (id)", ANCHORS, _SPLIT_OF.format(by="", rows="anchors"))),
    "w25_checksums": (w25_checksums, "SELECT doc_id, sha256(text) || '  docs/' || doc_id AS line FROM documents"),
    "i4_mask_check": (i4_mask_check, sql("SELECT DISTINCT id FROM pixels WHERE label = 3 AND class_id = 1", PIXELS)),
    "i8_upgraded": (i8_upgraded, "SELECT p_partkey AS id, p_partkey % 40 AS \"row\", p_partkey % 2 = 0 AS padded, p_partkey % 7 AS chunk, CASE WHEN p_partkey % 3 <> 0 THEN printf('mask_%07d.png,', p_partkey) ELSE '' END || printf('patch_%07d.png', p_partkey) AS files, p_size + p_partkey % 60 AS pixels, p_partkey % 10 / 10e0 AS empty_ratio FROM part"),
    "m7_class_statistics": (m7_class_statistics, sql("SELECT class_id, n AS pixels, p AS patches, round(n / (SELECT sum(n) FROM k), 9) AS frequency, round((SELECT median(f) FROM k) / f, 8) AS weight FROM k", PIXELS, _SPLIT_OF.format(by="", rows="(SELECT DISTINCT id FROM pixels)"), "k AS (SELECT class_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS p, sum(n) / sum(a) AS f FROM (SELECT class_id, n, sum(n) OVER (PARTITION BY id) AS a FROM (SELECT id, class_id, count(*) AS n FROM pixels WHERE id IN (SELECT id FROM split WHERE split = 'train') GROUP BY ALL)) GROUP BY class_id)")),
    "d16_stacks": (d16_stacks, "SELECT l_partkey AS pixel, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_shipdate, l_orderkey, l_linenumber) AS stack FROM lineitem GROUP BY l_partkey"),
    "s58_loaded": (s58_loaded, sql("SELECT id, round(avg((v - (SELECT avg(v) FROM pixels)) / (SELECT stddev_pop(v) FROM pixels)), 7) AS mean FROM pixels WHERE id IN (SELECT id FROM split WHERE split = 'val') GROUP BY id", PIXELS, _SPLIT_OF.format(by="", rows="(SELECT DISTINCT id FROM pixels)"))),
}

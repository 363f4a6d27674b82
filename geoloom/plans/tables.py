"""The operators' inputs derived from the relational tables, for Spark and as SQL for the oracle.

POINTS and BOXES are lon/lat positions of customers and suppliers; ANCHORS the parts as patch
anchors on a pixel grid; FEATURES the customers as axis-aligned pixel boxes with a class; SCENES the
events as a catalogue of images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATCH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37) % 36000 / 100.0 - 180).alias("lon"), ((k * 53) % 17000 / 100.0 - 85).alias("lat"), (k % 16 + 3).alias("zoom"))


POINTS = "points AS (SELECT c_custkey AS id, ((c_custkey * 37) % 36000) / 1e2 - 180 AS lon, ((c_custkey * 53) % 17000) / 1e2 - 85 AS lat, CAST(c_custkey % 16 + 3 AS BIGINT) AS zoom FROM customer)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    west, south = (k * 97) % 3400 / 10.0 - 170, (k * 61) % 1500 / 10.0 - 80
    return table(spark, sf_dir, "supplier").select(k.alias("id"), west.alias("west"), south.alias("south"), (west + (k * 13) % 50 / 10.0).alias("east"), (south + (k * 29) % 40 / 10.0).alias("north"), (k % 7 + 2).alias("zoom"))


BOXES = "boxes AS (SELECT id, west, south, west + w AS east, south + h AS north, zoom FROM (SELECT s_suppkey AS id, ((s_suppkey * 97) % 3400) / 1e1 - 170 AS west, ((s_suppkey * 61) % 1500) / 1e1 - 80 AS south, ((s_suppkey * 13) % 50) / 1e1 AS w, ((s_suppkey * 29) % 40) / 1e1 AS h, CAST(s_suppkey % 7 + 2 AS BIGINT) AS zoom FROM supplier))"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (F.floor(k / 50) * 64).alias("row"), ((k % 50) * 48).alias("col"), "p_brand", "p_size")


ANCHORS = 'anchors AS (SELECT p_partkey AS id, (p_partkey // 50) * 64 AS "row", (p_partkey % 50) * 48 AS col, p_brand, p_size FROM part)'


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, class_id (1..5 by name), class_name and a half-open pixel box r0, r1, c0, c1; a later id lies on top."""
    k = F.col("c_custkey")
    r0, c0 = F.floor(k * 17 / 10), (k * 71) % 2400
    names = F.array(*[F.lit(x) for x in SEGMENTS])
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.array_position(names, F.col("c_mktsegment")).cast("bigint").alias("class_id"), F.col("c_mktsegment").alias("class_name"), r0.alias("r0"), (r0 + 5 + k % 60).alias("r1"), c0.alias("c0"), (c0 + 5 + (k * 7) % 50).alias("c1"))


#: Fixed values of the customer table, in order.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_CASES = " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(SEGMENTS))
FEATURES = f"features AS (SELECT id, class_id, class_name, r0, r0 + 5 + id % 60 AS r1, c0, c0 + 5 + (id * 7) % 50 AS c1 FROM (SELECT c_custkey AS id, CAST(CASE c_mktsegment {_CASES} ELSE 0 END AS BIGINT) AS class_id, c_mktsegment AS class_name, (c_custkey * 17) // 10 AS r0, (c_custkey * 71) % 2400 AS c0 FROM customer))"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, area, taken, cloud (null for some)."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), (F.col("user_id") % 40).alias("area"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("taken"), F.when(e % 11 != 0, F.floor(F.col("value")) % 100).alias("cloud"))


SCENES = "scenes AS (SELECT event_id AS id, user_id % 40 AS area, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS taken, CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value) AS BIGINT) % 100 END AS cloud FROM events)"


def sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body

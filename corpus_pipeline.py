"""A corpus pipeline: five text operators, each on what the stages before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of documents. ORACLE_SQL is None: the
stages are beyond SQL and are tested against brute force.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables, and
drops columns that documents doesn't have, whatever their names; an empty table gives an empty table.
What else is defined stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm import common, decontaminate, mixing, quality, sharding, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 8
#: The rule for near-duplicates on word shingles.
SHINGLE = 5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows of a text are accepted or rejected together; a null text counts as empty; without trusted
    positives in the labels no row is accepted.
    """
    docs = docs.select(*COLUMNS)
    held_out = common.remainder(F.col("doc_id"), 4) == 2
    model = quality.train(docs.where(~held_out), quality.trusted(spark, sf_dir))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of near duplicates.

    Of rows with that doc_id the one of least text hash, then of least hash of all columns; rows of null
    doc_id stay; null and empty texts are a group; different texts of one doc_id are of their own groups.
    """
    docs = docs.select(*COLUMNS)
    return simhash.representatives(docs, shingle=SHINGLE).select(*COLUMNS)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts and items match nothing."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows that share doc_id, source and length are taken as often together, shared out evenly, the first
    by text hash once more; null is a source of its own; a text without words is taken as often as its
    source is taken whole.
    """
    docs = docs.select(*COLUMNS)
    key = ("doc_id", "source", "size")
    times = mixing.mix(docs).groupBy(*key).agg(F.sum("repeats").alias("total"), F.count(F.lit(1)).alias("n")).where("total > 0")
    times = common.written(times, "pipeline-times")
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    a, b = docs.withColumn("size", size).alias("a"), times.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    copies = lambda rows, n: rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*COLUMNS)
    columns = [F.col(f"a.{c}") for c in (*COLUMNS, "size")]
    out = copies(a.join(b.where("n = 1"), on).select(*columns, "b.total"), F.col("total"))
    if not times.where("n > 1").limit(1).count():
        return out
    several = a.join(b.where("n > 1"), on).select(*columns, "b.total", "b.n")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"), "text", "lang", "n_chars"))
    share = F.floor(F.col("total") / F.col("n")) + (rank <= F.col("total") % F.col("n")).cast("long")
    return out.unionByName(copies(several.withColumn("share", share).where("share > 0"), F.col("share")))


def placed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the shard and slot of each row; a null doc_id counts as the empty text, copies share a shard."""
    return sharding.shard(docs.select(*COLUMNS), "doc_id", (1.0,) * SHARDS)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", unseen), ("mixing", mixed), ("sharding", placed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

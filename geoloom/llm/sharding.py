"""Weighted rendezvous hashing of stable record keys over shards (operator 8).

Each shard draws a number from (seed, key, shard name) and weight w turns the draw u into the
score -w / ln(u); the largest score wins. A new shard changes a record's shard only by winning
itself, so growing from n to n + 1 shards moves 1 / (n + 1) of the records, all into the new one.

Defined results: a null key counts as the empty text; equal keys share a shard; an empty table
gives an empty table; columns of the input whose names equal an output column are replaced; a null
text has size 1 and the crc32 of the empty text. Slots are gapless from 0 in every shard also with
repeated keys: such rows are in the order of a hash of all their columns but maps, and rows equal in
those are exchangeable. Very long texts are read once and never held together.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import documents

#: Slices of the hash range within a shard, and parts of a slice, that are ranked apart: the slot table has at most shards x SLICES x PARTS rows.
SLICES = 256
PARTS = 16


def draw(seed: str, key: Column, part: str) -> Column:
    """Uniform in (0, 1): 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), F.lit(part), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shards") -> Column:
    """The shard number that wins key; weights[i] is the weight of shard i, which must be above 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    scores = [F.struct((F.lit(-float(w)) / F.log(draw(seed, key, f"shard{i}"))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["shard"]


def shard(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None, seed: str = "shards") -> DataFrame:
    """df with shard int, slot long and, if grown weights are given, grown_shard int.

    A slot is the rank by (slice, part, hash, key, hash of the row) in the shard. The range of the
    key's hash is cut into SLICES, each slice by the row's hash into PARTS, so that the rows of a hot
    key are ranked apart, and a table of at most len(weights) * SLICES * PARTS counts, small enough
    to broadcast whatever the size of df, gives the ranks before each part.
    """
    df = df.drop(*[c for c in df.columns if c in ("shard", "slot", "grown_shard")])
    own = f"__{uuid.uuid4().hex}"  # no column of df has these names
    u, row, piece, start, rank = (f"{own}_{x}" for x in ("u", "row", "slice", "start", "rank"))
    k = F.col(f"`{key}`")
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    placed = df.withColumns({"shard": rendezvous(k, weights, seed), u: draw(seed, k, "slot"), row: F.xxhash64(*hashed)})
    place = F.floor(F.col(u) * SLICES) * PARTS + F.pmod(F.col(row), F.lit(PARTS))
    placed = placed.withColumn(piece, place.cast("int"))
    counts = placed.groupBy("shard", piece).agg(F.count(F.lit(1)).alias(start))
    before = Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", piece, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy("shard", piece).orderBy(u, k, row)))
    ranked = ranked.join(F.broadcast(starts), ["shard", piece])
    out = {"slot": F.col(start) + F.col(rank) - 1}
    if grown is not None:
        out["grown_shard"] = rendezvous(k, grown, seed)
    return ranked.withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns], "shard", F.col("slot").cast("long").alias("slot"), *(["grown_shard"] if grown is not None else []))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, "doc_id", (1.0,) * 8, (1.0,) * 9).withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

"""Leakage-safe splits of patches (name, row, col, ...) as window, fold and semi/anti-join queries.

A seeded MD5 of the key orders rows, so that any engine can repeat a split. Ranks are taken in hash
ranges and shifted by the counts of the ranges before, so that no task orders a whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col


def order_key(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def hash_rank(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """df with rank (from 1, by the hex text `order`) and n (rows) within `by`."""
    df = df.withColumn("__range", F.substring(order, 1, 3))
    counts = df.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__m"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__range", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"), F.sum("__m").over(whole).alias("n"))
    inner = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order))
    on = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in [*by, "__range"]]
    ranked = df.withColumn("__rank", inner).alias("a").join(counts.alias("b"), on)
    return ranked.select("a.*", (c("__rank") + c("__before")).alias("rank"), c("b.n").alias("n")).drop("__rank", "__range")


def test_size(n: Column, test: float) -> Column:
    return F.ceil(n * F.lit(test)).cast("bigint")


def val_size(n: Column, test: float, val: float) -> Column:
    return F.ceil((n - test_size(n, test)) * F.lit(val)).cast("bigint")


def by_rank(test: float, val: float) -> Column:
    """The split of a row of rank `rank` among `n`."""
    t = test_size(c("n"), test)
    return F.when(c("rank") <= t, "test").when(c("rank") <= t + val_size(c("n"), test, val), "val").otherwise("train")


def random_split(df: DataFrame, key: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    ranked = hash_rank(df.withColumns({"__o": order_key(seed, c(key)), "__all": F.lit(0)}), ["__all"], "__o")
    return ranked.withColumn("split", by_rank(test, val)).drop("__o", "__all", "rank", "n")


def stratified_split(df: DataFrame, key: str, strata: Sequence[str], test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    ranked = hash_rank(df.withColumn("__o", order_key(seed, c(key))), strata, "__o")
    return ranked.withColumn("split", by_rank(test, val)).drop("__o", "rank", "n")


def assigned(groups: DataFrame, test: float, val: float) -> DataFrame:
    """groups (group, size, order) with split: in order, a group goes to test if that brings test nearer to its size, else
    so to val, else to train.

    The rule reads the sizes so far, so one task folds the table of groups; it streams and keeps two counters.
    """
    n = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    test_n = math.ceil(n * test)
    val_n = math.ceil((n - test_n) * val)
    kind = groups.schema["group"].dataType.simpleString()

    def fold(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = v = 0
        for batch in found:
            names = []
            for size in batch.column(1).to_pylist():
                if abs(t + size - test_n) < abs(t - test_n):
                    t += size
                    names.append("test")
                elif abs(v + size - val_n) < abs(v - val_n):
                    v += size
                    names.append("val")
                else:
                    names.append("train")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["group", "split"])

    return groups.select("group", "size", "order").repartition(1).sortWithinPartitions("order").mapInArrow(fold, f"group {kind}, split string")


def overlapping(candidates: DataFrame, held_out: DataFrame, patch: int) -> DataFrame:
    """The candidates (row, col) that share pixels with a held-out patch, by an equi-join on patch-sized cells."""
    near = F.array(*[F.struct((F.floor(c("row") / patch) + i).alias("cr"), (F.floor(c("col") / patch) + j).alias("cc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    others = held_out.select(c("row").alias("__r"), c("col").alias("__c"), F.inline(near)).alias("b")
    own = candidates.withColumns({"cr": F.floor(c("row") / patch), "cc": F.floor(c("col") / patch)}).alias("a")
    close = (F.abs(c("a.row") - c("b.__r")) < patch) & (F.abs(c("a.col") - c("b.__c")) < patch)
    return own.join(others, (c("a.cr") == c("b.cr")) & (c("a.cc") == c("b.cc")) & close, "left_semi").drop("cr", "cc")


def default_block(patches: DataFrame, patch: int) -> int:
    r = patches.agg(F.max("row"), F.max("col")).first()
    if r[0] is None:
        return 4 * patch
    fitting = int(math.sqrt((r[0] + patch) * (r[1] + patch) / 10)) // patch * patch
    return max(patch, min(4 * patch, fitting))


def grouped_split(df: DataFrame, key: str, group: Column, patch: int | None, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """df with split by whole groups; patches that overlap one held out before theirs become 'dropped'."""
    df = df.withColumn("__g", group)
    groups = df.groupBy(c("__g").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    split = assigned(groups.withColumn("order", order_key(seed, c("group"))), test, val)
    out = df.join(split.withColumnRenamed("group", "__g"), "__g").drop("__g")
    if patch is None:
        return out
    part = lambda name: out.where(c("split") == name)
    leak_val = overlapping(part("val"), part("test"), patch).select(key)
    val_kept = part("val").join(leak_val, key, "left_anti")
    leak_train = overlapping(part("train"), part("test").unionByName(val_kept), patch).select(key)
    dropped = leak_val.unionByName(leak_train).withColumn("__d", F.lit(True))
    return out.join(dropped, key, "left").withColumn("split", F.when(c("__d"), "dropped").otherwise(c("split"))).drop("__d")


def spatial_split(df: DataFrame, key: str, patch: int, block: int | None = None, **options) -> DataFrame:
    block = block or default_block(df, patch)
    return grouped_split(df, key, F.concat_ws("_", F.floor(c("row") / block), F.floor(c("col") / block)), patch, **options)


def sampled(df: DataFrame, key: str, strata: Sequence[str], limit: int, seed: int = 42) -> DataFrame:
    """About `limit` rows with the mix of strata kept: of m of N rows round-half-even(m / N * limit)."""
    total = df.count()
    ranked = hash_rank(df.withColumn("__o", order_key(seed, c(key))), strata, "__o")
    return ranked.where(c("rank") <= F.bround(c("n") / float(max(total, 1)) * limit)).drop("__o", "rank", "n")


def labelled(train: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """train with labelled: the first ceil(n * ratio) in a seeded order."""
    ranked = hash_rank(train.withColumns({"__o": order_key(seed, c(key), F.lit("labelled")), "__all": F.lit(0)}), ["__all"], "__o")
    return ranked.withColumn("labelled", c("rank") <= F.ceil(c("n") * F.lit(ratio))).drop("__o", "__all", "rank", "n")


def ratio_name(ratio: float) -> str:
    return format(round(ratio * 100, 4), "g")


def entry_class(has_background: Column, has_labels: Column, empty_ratio: Column) -> Column:
    """0 empty, 1 wholly labelled, 2 mixed; by the share of empty pixels where there is no mask."""
    by_mask = F.when(has_background & ~has_labels, 0).when(has_labels & ~has_background, 1).otherwise(2)
    by_image = F.when(empty_ratio >= 1, 0).when(empty_ratio <= 0, 1).otherwise(2)
    return F.when(has_background | has_labels, by_mask).otherwise(by_image).cast("bigint")


def share_warnings(df: DataFrame, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """split, rows, share, off: splits whose share misses the wanted one by over a tenth."""
    wanted = {"test": test, "val": (1 - test) * val, "train": (1 - test) * (1 - val)}
    aim = F.coalesce(*[F.when(c("split") == k, F.lit(v)) for k, v in wanted.items()])
    counts = df.where(c("split") != "dropped").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("split", "rows", (F.abs(c("rows") / c("total") - aim) > 0.1).alias("off"))


def in_several(splits: DataFrame, key: str) -> DataFrame:
    """Names that more than one split lists."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")

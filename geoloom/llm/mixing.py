"""Mixing sources to target weights by subset-sum budget fitting (operator 1).

Documents are counted by (source, exact length in words). A source whose target is T and whose size
is S takes floor(T / S) whole copies of itself and a subset of R = T - floor(T / S) * S words. The
subset is found on the length counts alone: proportional counts for all but a slack of the budget,
then bounded-knapsack dynamic programming (a bitset of reachable sums, counts split in powers of
two) for the rest, the nearest sum there is. Bitsets of some steps are kept, those between made
again. Where texts are so long that a bitset would pass DP_BITS, lengths count in units of several
words first and what the units leave over is settled in words. Seeded hashes choose which documents
of each length are taken.

Defined results: a null text has size 0 and takes 0 words; null is a source of its own, last in
order; a source without words has target 0; an empty table gives an empty table; repeated rows are
rows of their own, of which it doesn't matter which is taken; other columns are ignored, whatever
their names. Very long texts: beyond DP_BITS / 6 words the sum may miss its budget by a unit for each
document that dynamic programming takes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import WORD, bounded, documents, written

#: Bits of a bitset of reachable sums: lengths count in units of several words where they need more.
DP_BITS = 1 << 24
#: Rows of a (source, length) group that one task ranks.
RANK_ROWS = 2000
#: Rows of the plan up to which it is broadcast; above, the join shuffles.
BROADCAST_ROWS = 200_000
#: A target stops at so many times its source's size, and so does each document.
MOST_REPEATS = 3


def fill_targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = MOST_REPEATS) -> list[float]:
    """Shares of budget by weight, none above most * size; the excess goes to the others by weight until none is above.

    Sources reach their bound in the order of bound to weight, as what is left rises for the others.
    """
    targets, left, total = [0.0] * len(sizes), float(budget), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for at, i in enumerate(order):
        if left * weights[i] / total <= most * sizes[i]:
            for j in order[at:]:
                targets[j] = left * weights[j] / total
            break
        targets[i] = float(most * sizes[i])
        left, total = left - targets[i], total - weights[i]
    return targets


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length come nearest to budget, below it where equally near; none above its count."""
    limit = budget + max((n for n, c in zip(lengths, counts, strict=True) if c), default=0)
    steps, mask = [], (1 << (limit + 1)) - 1
    for i in sorted(range(len(lengths)), key=lambda j: lengths[j]):
        left, part = min(counts[i], limit // lengths[i] if lengths[i] else 0), 1
        while left:
            steps.append((i, min(part, left)))
            left, part = left - steps[-1][1], part * 2
    add = lambda reach, step: reach | (reach << (step[1] * lengths[step[0]])) & mask
    stride, reach, kept, made = max(1, math.isqrt(len(steps))), 1, [], 0
    for made, step in enumerate(steps):
        if reach >> budget & 1:
            break
        if made % stride == 0:
            kept.append(reach)
        reach = add(reach, step)
    else:
        made = len(steps)
    below, over = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1, reach >> (budget + 1)
    above = budget + (over & -over).bit_length()
    at, used = (above if over and above - budget < budget - below else below), [0] * len(lengths)
    for first in reversed(range(0, made, stride)):
        part = steps[first : min(first + stride, made)]
        before = [kept[first // stride]]
        for step in part[:-1]:
            before.append(add(before[-1], step))
        for (i, n), reach in zip(reversed(part), reversed(before), strict=True):
            if not reach >> at & 1:
                at -= n * lengths[i]
                used[i] += n
    return used


def nearest(lengths: Sequence[int], counts: Sequence[int], budget: int, bits: int = DP_BITS) -> list[int]:
    """knapsack() in bitsets of about `bits`: in units of words first, where whole words would need more."""
    longest = max((n for n, c in zip(lengths, counts, strict=True) if c), default=0)
    unit = -(-(budget + longest + 1) // bits)
    if unit <= 1:
        return knapsack(lengths, counts, budget)
    used = knapsack([-(-n // unit) for n in lengths], counts, budget // unit)
    left = budget - sum(u * n for u, n in zip(used, lengths, strict=True))
    short = [c - u if n < bits else 0 for n, c, u in zip(lengths, counts, used, strict=True)]
    if 0 < left < bits:
        used = [u + more for u, more in zip(used, knapsack(lengths, short, left), strict=True)]
    return used


def fit(lengths: Sequence[int], counts: Sequence[int], target: float, most: int = MOST_REPEATS, bits: int = DP_BITS) -> tuple[int, list[int]]:
    """Whole copies of the source, and how many documents of each length are taken once more."""
    size = sum(a * b for a, b in zip(lengths, counts, strict=True))
    whole = min(most, math.floor(target / size)) if size else 0
    budget = 0 if not size or whole == most else min(size, round(target - whole * size))
    taken, extra, spent = [0] * len(lengths), 0.0, 0
    slack = min(budget, 4 * max(lengths, default=0))
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        if lengths[i]:
            extra += (budget - slack) / size * counts[i] * lengths[i] if size else 0
            taken[i] = min(counts[i], max(0, int((extra - spent) // lengths[i])))
            spent += taken[i] * lengths[i]
    if budget > spent:
        for i, more in enumerate(nearest(lengths, [c - t for c, t in zip(counts, taken, strict=True)], budget - spent, bits)):
            taken[i] += more
    return whole, taken


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """A row for each row of df: key, source, size, source_size, target, repeats (times the mix takes it).

    Weights repeat over the sources in code-point order, null last. Only counts travel: the histogram
    is aggregated before its shuffle, one task fits one source's distinct lengths, and documents are
    ranked in hash buckets of about RANK_ROWS, so that no task holds a hot source or length.
    """
    weights = list(weights)
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("src"), size.alias("size")), "mix-sizes")
    lengths = written(sized.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")

    def targets(rows: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(rows)), key=lambda i: (rows.src[i] is None, (rows.src[i] or "").encode()))
        rows = rows.iloc[order].reset_index(drop=True)
        sizes = [int(x) for x in rows.source_size]
        return rows.assign(target=fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], sum(sizes)))[["src", "source_size", "target"]]

    per_source = lengths.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = per_source.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(targets, "src string, source_size long, target double")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        whole, once = fit(rows["size"].tolist(), rows.n.tolist(), float(rows.target[0]))
        return rows.assign(whole=whole, once=np.array(once, np.int64))[["src", "size", "n", "source_size", "target", "whole", "once"]]

    same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
    with_aims = lengths.alias("a").join(aims.alias("b"), same("src", "src")).select("a.src", "a.size", "a.n", "b.source_size", "b.target")
    plan = written(with_aims.groupBy("src").applyInPandas(fitted, "src string, size long, n long, source_size long, target double, whole long, once long"), "mix-plan")
    side = F.broadcast(plan) if bounded(plan, BROADCAST_ROWS) else plan
    rows = sized.alias("a").join(side.alias("b"), same("src", "src") & (F.col("a.size") == F.col("b.size"))).select("a.key", "a.src", "a.size", "b.n", "b.source_size", "b.target", "b.whole", "b.once")
    # Of each length the first `once` documents by (bucket, hash) are taken once more.
    draw = F.xxhash64(F.lit(seed), F.col("key"))
    rows = rows.withColumns({"draw": draw, "bucket": F.pmod(F.shiftright(draw, 7), F.ceil(F.col("n") / RANK_ROWS)).cast("long")})
    some = (F.col("once") > 0) & (F.col("once") < F.col("n"))
    by = ["src", "size", "bucket"]
    # Rows of one key, source and length are alike: they are counted before they are ranked.
    alike = rows.where(some).groupBy(*by, "draw", "key", "source_size", "target", "whole", "once").agg(F.count(F.lit(1)).alias("rows"))
    counts = rows.where(some).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy(*by).orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("rank", F.coalesce(F.sum("rows").over(within), F.lit(0)))
    ranked = ranked.alias("a").join(counts.alias("b"), same("src", "src") & (F.col("a.size") == F.col("b.size")) & (F.col("a.bucket") == F.col("b.bucket"))).select("a.*", "b.before")
    ranked = ranked.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    out = lambda frame, more: frame.select("key", "src", "size", "source_size", "target", (F.col("whole") + more).alias("repeats"))
    every = out(rows.where(~some), F.when(F.col("once") > 0, 1).otherwise(0))
    return every.unionByName(out(ranked, (F.col("before") + F.col("rank") + F.col("place") <= F.col("once")).cast("long"))).select(F.col("key").alias(key), F.col("src").alias(source), "size", "source_size", "target", "repeats")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "repeats", "source")

"""Language-model scoring with a probabilistic suffix tree over words (operator 3).

Symbols are the training words, one class for all unseen words, and the end of a text, which also
stands before its first word. The root's distribution is the add-one-half estimate of the base. A
context of up to DEPTH words is a candidate if it occurs LEAST_COUNT times or more, and keeps the
next symbols that follow it so often, whatever the size of the corpus. A candidate is retained if the
divergence of its next-symbol distribution from that of its longest retained suffix, times its count,
is at least GAIN nats; every occurrence is judged by the counts without itself, and symbols that were
not kept count against it. Distributions are smoothed into those of the suffix. A symbol is scored by
the state of the longest retained suffix before it.

The tree is a table of sequences of words, by hash. What a sequence adds to the score of a text, as
context and next symbol and as context of what follows, is one weight, so a text's score is the sum
of those of all sequences in it. Words are counted over the whole training corpus, longer sequences
in one more scan for each length, among those whose two parts may occur often enough by a bitmap of
a fixed size. The MOST sequences and MOST_WORDS words of the highest counts are looked up in the scan
that scores, the others by a join. Words are known by 64-bit hashes.

Defined results: a null or empty text is the end symbol alone; a null key counts as the empty text
for the split into training and held-out rows; a repeated row is learned and scored again; without
training rows every score is 0; an empty table gives an empty table; other columns are ignored,
whatever their names. A very long text is a batch of its own: its task needs some hundred bytes for
each of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import batches, bitmap, documents, mapped, release, remainder, texts, word_hashes, written

#: Occurrences that a context and a kept next symbol need.
LEAST_COUNT = 3
#: Words of the longest context.
DEPTH = 3
#: Sequences that are broadcast, 16 bytes each.
MOST = 3_000_000
#: The end of a text as a word's hash, and what stands before its first word.
END, START = 0x1F3D5B79A2C4E680, 0x6A09E667F3BCC908
#: Bits by which a sequence's hash is rotated for each word that follows.
ROLL = 11
GAIN = 10.0
#: Weight of the suffix's distribution, in counts.
SMOOTH = 4.0
#: Words that are broadcast, 16 bytes each.
MOST_WORDS = 1_000_000
BATCH_BYTES = 2 << 20
#: Distinct counts that a task holds before it sends them on.
HELD = 1 << 21
#: Distinct sequences that a task holds before it sends them on, 24 bytes each.
HELD_SEQUENCES = 3 << 19
WORDS, TEXTS = 0, 1


class Lookup:
    """Values of uniform 64-bit keys: sorted keys, and where those of each range of hashes begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """keys in order as unsigned numbers."""
        self.keys, self.values = keys.view(np.uint64), values
        self.shift = np.uint64(64 - max(1, min(30, len(keys).bit_length())))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among values, -1 where there is none."""
        out = np.full(len(keys), -1)
        if not len(self.keys):
            return out
        keys = keys.view(np.uint64)
        open_, at = np.arange(len(keys)), self.first[(keys >> self.shift).astype(np.int64)].astype(np.int64)
        while len(open_):
            there = at < len(self.keys)
            open_, at = open_[there], at[there]
            found, wanted = self.keys[at], keys[open_]
            hit = found == wanted
            out[open_[hit]] = at[hit]
            more = found < wanted
            open_, at = open_[more], at[more] + 1
        return out


def sequence(codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with an end before and after each; whether the next one belongs to the same text."""
    stops = np.cumsum(sizes + 2)
    words = np.ones(int(stops[-1]) if len(stops) else 0, bool)
    words[stops - 1] = False
    inside = words.copy()
    words[stops - sizes - 2] = False
    out = np.full(len(words), end, np.int64)
    out[words] = codes
    inside[stops - sizes - 2] = True
    return out, inside


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def tally(rows: DataFrame, count: Callable[[list[bytes]], Iterator[tuple[int, np.ndarray, np.ndarray]]], kinds: int = 1) -> DataFrame:
    """kind, key, n: what count gives for each batch of texts, added up in the task and then over all."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(kinds)]

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = added(*map(list, zip(*held[kind], strict=True)))
            held[kind] = []
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part]), pa.array(n[part])], ["kind", "key", "n"])

        for batch in batches(found, BATCH_BYTES):
            for kind, keys, n in count(texts(batch)):
                held[kind].append((keys, n))
                if sum(len(k) for k, _ in held[kind]) >= HELD:
                    held[kind] = [added(*map(list, zip(*held[kind], strict=True)))]
                    if len(held[kind][0][0]) > HELD // 2:
                        yield from out(kind)
        for kind in range(kinds):
            if held[kind]:
                yield from out(kind)

    return rows.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def rolled(x: np.ndarray) -> np.ndarray:
    u = x.view(np.uint64)
    return (u << np.uint64(ROLL) | u >> np.uint64(64 - ROLL)).view(np.int64)


def rotated(c: Column, bits: int) -> Column:
    return F.shiftleft(c, bits % 64).bitwiseOR(F.shiftrightunsigned(c, 64 - bits % 64)) if bits % 64 else c


def sequences(hashes: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length 1 .. most the hashes of the sequences that end at each place of all texts, and the places that have one."""
    words, inside = sequence(hashes, sizes, END)
    first = np.append(True, ~inside[:-1])[: len(words)]
    words[first] = START
    starts = np.flatnonzero(first)
    place = np.arange(len(words)) - np.repeat(starts, sizes + 2)
    keys = words
    for length in range(1, most + 1):
        yield keys, np.flatnonzero(place >= length - 1)
        keys = rolled(np.append(np.int64(0), keys[:-1])) ^ words


def often(rows: DataFrame, length: int, bits: np.ndarray) -> DataFrame:
    """key, ctx (all but the last word), n of the sequences of a length that occur LEAST_COUNT times or more; bits has those one shorter."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, contexts, n = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            each = keys[first], contexts[order[first]], np.add.reduceat(n[order], first)
            for i in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in each], ["key", "ctx", "n"])

        for batch in batches(found, BATCH_BYTES):
            *_, (shorter, _), (keys, at) = sequences(*word_hashes(texts(batch)), length)
            there = mapped(shared.value, shorter)
            at = at[there[at] & there[at - 1]]
            each, where, n = np.unique(keys[at], return_index=True, return_counts=True)
            held.append((each, shorter[at[where] - 1], n.astype(np.int64)))
            if sum(len(x) for x, *_ in held) >= HELD_SEQUENCES:
                yield from out()
        if sum(len(x) for x, *_ in held):
            yield from out()

    return rows.mapInArrow(run, "key long, ctx long, n long").groupBy("key", "ctx").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def learn(rows: DataFrame, words: DataFrame, n_texts: int, norm: float, depth: int) -> DataFrame:
    """key, n, weight of the sequences that matter; words: word, n of all training words."""
    spark = rows.sparkSession
    ends = spark.createDataFrame([(END, n_texts), (START, n_texts)], "key long, n long")
    last = words.select(F.col("word").alias("key"), "n").unionByName(ends).where(F.col("n") >= LEAST_COUNT)
    last = written(last.select("key", "n", F.col("key").alias("first"), ((F.col("n") + 0.5) / F.lit(norm)).alias("chance")), "suffixtree-words")
    n, total, below = F.col("n"), F.col("total"), F.col("below")
    back = F.log10(F.lit(SMOOTH) / (total + SMOOTH))
    parts = []
    for length in range(2, depth + 2):
        edges = often(rows, length, bitmap(last.select("key"))).join(last.select(F.col("key").alias("ctx"), F.col("n").alias("occurs"), "first"), "ctx")
        edges = edges.withColumn("suffix", F.col("key").bitwiseXOR(rotated(F.col("first"), ROLL * (length - 1))))
        edges = written(edges.join(last.select(F.col("key").alias("suffix"), F.col("chance").alias("below")), "suffix").drop("suffix"), "suffixtree-edges")
        stats = edges.groupBy("ctx").agg(F.sum("n").alias("total"), F.max("occurs").alias("occurs"), F.sum(n * (F.log(n - 1 + SMOOTH * below) - F.log(below))).alias("won"))
        won = F.col("won") - total * F.log(total - 1 + SMOOTH) + F.greatest(F.col("occurs") - total, F.lit(0)) * F.log(F.lit(SMOOTH) / (total + SMOOTH))
        kept = written(stats.where(won >= GAIN).select("ctx", "total", "occurs"), "suffixtree-kept")
        chance = F.coalesce((n + SMOOTH * below) / (total + SMOOTH), below)
        table = edges.drop("occurs").join(kept.drop("occurs"), "ctx", "left").select("key", "n", "first", chance.alias("chance"), F.when(total.isNotNull(), F.log10(chance / below) - back).alias("weight"))
        last = written(table, "suffixtree-level")
        parts += [last.where("weight is not null").select("key", "n", "weight"), kept.select(F.col("ctx").alias("key"), F.col("occurs").alias("n"), back.alias("weight"))]
        release(spark)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return written(out.groupBy("key").agg(F.max("n").alias("n"), F.sum("weight").alias("weight")), "suffixtree-weights")


def split(weights: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The sequences of the highest counts, at most so many, and the others, if there are."""
    scale = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in sorted(weights.groupBy(scale.alias("at")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            least = r["at"]
            break
    if least is None:
        return weights, None
    return weights.where(scale > least), weights.where(scale <= least)


def brought(table: DataFrame) -> Broadcast:
    """Both columns of a table of bounded size, sorted for Lookup; nothing of it stays in the driver."""
    keys, values = (x.to_numpy() for x in table.toArrow().columns)
    order = np.argsort(keys.view(np.uint64))
    return table.sparkSession.sparkContext.broadcast((keys[order], values[order]))


def score(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, most: int = MOST, most_words: int = MOST_WORDS) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score for each row of docs, learned from train."""
    spark = docs.sparkSession
    rows = train.select(F.col(f"`{text}`").alias("text"))

    def words_and_texts(parts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        hashes, _ = word_hashes(parts)
        yield WORDS, *np.unique(hashes, return_counts=True)
        yield TEXTS, np.zeros(1, np.int64), np.array([len(parts)])

    counts = written(tally(rows, words_and_texts, 2), "suffixtree-counts")
    release(spark)
    n_texts, n_words, distinct = counts.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, v)), F.lit(0)) for k, v in ((TEXTS, F.col("n")), (WORDS, F.col("n")), (WORDS, F.lit(1)))]).first()
    tokens, kinds = n_words + n_texts, distinct + (n_texts > 0)
    norm = tokens + 0.5 * (kinds + 1)
    words = counts.where(F.col("kind") == WORDS).select(F.col("key").alias("word"), "n")
    weights = learn(rows, words, n_texts, norm, depth)
    some_words, seldom = split(words, most_words)
    top, others = split(weights, most)
    # What is not in a map of all training words or sequences needs no lookup and no join.
    shared = [brought(some_words.select("word", "n")), spark.sparkContext.broadcast(bitmap(words.select("word"))), brought(top.select("key", "weight")), spark.sparkContext.broadcast(bitmap(weights.select("key")))]
    release(spark)
    with_words, with_longer = seldom is not None, others is not None
    kind = docs.schema[key].dataType.simpleString()
    ends = float(np.log10(n_texts + 0.5))

    def lists(by: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
        values = values[np.argsort(by, kind="stable")]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(by, minlength=n))).astype(np.int32)), pa.array(values))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, all_words, known_longer, all_longer = Lookup(*shared[0].value), shared[1].value, Lookup(*shared[2].value), shared[3].value
        row = TaskContext.get().partitionId() << 40
        none = np.zeros(0, np.int64)
        for batch in batches(found, BATCH_BYTES):
            parts = texts(batch)
            hashes, n = word_hashes(parts)
            owner = np.repeat(np.arange(len(parts)), n)
            at = known_words.find(hashes)
            there = at >= 0
            rare = ~there & mapped(all_words, hashes) if with_words else np.zeros(len(at), bool)
            logs = np.log10((known_words.values[at] if len(known_words.values) else np.zeros(len(at))) * there + 0.5)
            known = np.bincount(owner, there, len(parts)).astype(np.int64) + (n_texts > 0)
            base = np.bincount(owner, np.where(rare, 0.0, logs), len(parts)) + ends
            place = np.repeat(np.arange(len(parts)), n + 2)
            extra, seldom = np.zeros(len(parts)), [(none, none)]
            for keys, at in sequences(hashes, n, depth + 1):
                at = at[mapped(all_longer, keys)[at]]
                hit = known_longer.find(keys[at])
                extra += np.bincount(place[at[hit >= 0]], known_longer.values[hit[hit >= 0]], len(parts))
                if with_longer:
                    seldom.append((place[at[hit < 0]], keys[at[hit < 0]]))
            by, longer = map(np.concatenate, zip(*seldom, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(parts))), batch.column(0), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(extra), lists(owner[rare], hashes[rare], len(parts)), lists(by, longer, len(parts))], ["row", "key", "n_tokens", "known", "base", "extra", "rare", "longer"])
            row += len(parts)

    found = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"row long, key {kind}, n_tokens long, known long, base double, extra double, rare array<long>, longer array<long>")
    out = found = written(found, "suffixtree-scores")
    if with_words:
        each = found.select("row", F.explode("rare").alias("word")).join(seldom, "word", "left")
        rest = each.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"))
        out = out.join(rest, "row", "left").withColumns({"known": F.col("known") + F.coalesce("more", F.lit(0)), "base": F.col("base") + F.coalesce("logs", F.lit(0.0))})
    if with_longer:
        each = found.select("row", F.explode("longer").alias("key")).join(others.select("key", "weight"), "key")
        out = out.join(each.groupBy("row").agg(F.sum("weight").alias("joined")), "row", "left").withColumn("extra", F.col("extra") + F.coalesce("joined", F.lit(0.0)))
    base = F.col("base") - F.col("n_tokens") * float(np.log10(norm))
    return out.select(F.col("key").alias(key), "n_tokens", F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("extra")).alias("score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 5) == 1
    return score(docs, docs.where(~held_out)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

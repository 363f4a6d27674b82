"""Benchmark decontamination by spaced-seed hashing (operator 10).

A seed is a mask over consecutive words of which only some count, so that a substituted word breaks
just the seeds that read it. The hashes of every mask at every place of the benchmark items are
matched with those at every place of every document. Around each hit the two texts are laid over
each other without gaps and the best stretch (a match counts 1, a substitution -3) is kept if it has
enough matches; an insertion leaves two such stretches.

The benchmark is the query set. One of at most BLOCK_WORDS words is broadcast and meets all documents
in one scan without a shuffle, whatever the number of copies of a passage. Of a larger one the hashes
of all seeds are a bitmap and a table first: one scan and an equi-join find the documents that have
any, and only those meet the items, in blocks of so many words.

Defined results: words are lower-cased in A-Z and lose punctuation at their ends (a word of nothing
else stays); a null or empty text or item matches nothing; items of fewer than MIN_MATCH words match
where all their words do, but never those of fewer than the shortest mask; of stretches with equal
matches the one that begins earliest in the document against the item's start is given, and in it
the first; a repeated document or item gives its rows again; empty tables give an empty table; other
columns are ignored, whatever their names. A very long text is a batch of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import batches, bitmap, bounded, documents, mapped, packed, texts, unpacked, written

#: Which of consecutive words a seed reads.
MASKS = ("11011", "1101011", "11001011", "110100101")
MIN_MATCH = 8
MISS = 3
BLOCK_WORDS = 1 << 18
BLOOM_BITS = 22
#: Documents that have a seed of a large benchmark up to which their keys are broadcast; above, the join shuffles.
BROADCAST_ROWS = 200_000
BATCH_BYTES = 2 << 20
ENDS = b".,;:!?\"'()[]{}<>|*#%&$-_"


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each word of all texts; where each text starts; words in each."""
    index: dict[bytes, int] = {}
    lengths, ids = [], []
    for x in parts:
        words = x.lower().split()
        lengths.append(len(words))
        ids += [index.setdefault(w, len(index)) for w in words]
    table = np.fromiter((xxhash.xxh64_intdigest(w.strip(ENDS) or w) for w in index), np.uint64, len(index))
    n = np.array(lengths, np.int64)
    return table[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64), np.cumsum(n) - n, n


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the mask at each place where it fits."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.full(n, 0x9E3779B97F4A7C15 * (number + 1) % 2**64, np.uint64)
    for i, read in enumerate(mask):
        if read == "1":
            out = (out ^ words[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out


class Block:
    """Items with the hashes of their seeds in order."""

    def __init__(self, ids: list[int], parts: list[bytes]):
        self.ids = ids
        self.words, self.starts, self.lengths = word_hashes(parts)
        found = []
        for number, mask in enumerate(MASKS):
            h = seeds(self.words, mask, number)
            item = np.repeat(np.arange(len(ids)), self.lengths)[: len(h)]
            at = np.arange(len(h))
            fits = at + len(mask) <= self.starts[item] + self.lengths[item]
            found.append((h[fits], item[fits], at[fits]))
        h, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        self.seeds, self.item, self.at = h[order], item[order], at[order]
        self.bloom = np.zeros(1 << BLOOM_BITS, bool)
        self.bloom[self.seeds >> np.uint64(64 - BLOOM_BITS)] = True

    def overlaps(self, parts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first word in the text, first word in the item, words, matches): the best stretch of each pair."""
        words, starts, lengths = word_hashes(parts)
        owner = np.repeat(np.arange(len(parts)), lengths)
        diagonals = set()
        for number, mask in enumerate(MASKS):
            h = seeds(words, mask, number)
            at = np.flatnonzero(self.bloom[h >> np.uint64(64 - BLOOM_BITS)])
            at = at[at + len(mask) <= starts[owner[at]] + lengths[owner[at]]]
            low, high = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
            hit = high > low
            for place, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                text = int(owner[place])
                diagonals.update((text, i, place - p) for i, p in zip(self.item[a:b].tolist(), self.at[a:b].tolist(), strict=True))
        best: dict[tuple[int, int], tuple] = {}
        for text, item, shift in sorted(diagonals):
            first, n = int(self.starts[item]), int(self.lengths[item])
            begin = max(first, int(starts[text]) - shift)
            end = min(first + n, int(starts[text] + lengths[text]) - shift)
            same = words[begin + shift : end + shift] == self.words[begin:end]
            a, b = stretch(same)
            matches = int(same[a:b].sum())
            if matches >= min(MIN_MATCH, n) and matches > best.get((text, item), (0,) * 6)[5]:
                best[text, item] = (text, item, begin + a + shift - int(starts[text]), begin + a - first, b - a, matches)
        return [best[k] for k in sorted(best)]


def stretch(same: np.ndarray) -> tuple[int, int]:
    """Bounds of the stretch with the largest sum of 1 for True and -MISS for False; the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISS))])
    least = np.minimum.accumulate(total)
    end = int((total - least).argmax())
    return int(total[: end + 1].argmin()), end


def blocks(items: DataFrame, key: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of at most block_words words, or one item."""
    ids, parts, held = [], [], 0
    for row in items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        n = len(row.t.split())
        if ids and held + n > block_words:
            yield Block(ids, parts)
            ids, parts, held = [], [], 0
        ids.append(row.k)
        parts.append(row.t.encode())
        held += n
    if ids:
        yield Block(ids, parts)


def item_seeds(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every mask at every place of all texts where it fits, and the text of each."""
    words, starts, lengths = word_hashes(parts)
    owner = np.repeat(np.arange(len(parts)), lengths)
    found = []
    for number, mask in enumerate(MASKS):
        h = seeds(words, mask, number)
        own = owner[: len(h)]
        fits = np.arange(len(h)) + len(mask) <= starts[own] + lengths[own]
        found.append((h[fits], own[fits]))
    h, own = (np.concatenate(x) for x in zip(*found, strict=True))
    return h.view(np.int64), own


def seeded(docs: DataFrame, items: DataFrame, key: str, text: str, item_text: str) -> DataFrame:
    """The rows of docs that have a seed of an item, or no key: one scan, whatever the number of items.

    A map of all items' hashes lets few places through; those meet the hashes in a join.
    """
    spark = docs.sparkSession

    def hashes(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(item_seeds(texts(batch))[0]))], ["h"])

    known = written(items.select(F.col(f"`{item_text}`").alias("text")).mapInArrow(hashes, "h long").distinct(), "decontaminate-seeds")
    shared = spark.sparkContext.broadcast(bitmap(known))
    kind = docs.schema[key].dataType.simpleString()

    def hits(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, BATCH_BYTES):
            h, own = item_seeds(texts(batch))
            some = mapped(shared.value, h)
            pairs = np.unique(np.stack([own[some], h[some]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["key", "h"])

    places = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("key is not null").mapInArrow(hits, f"key {kind}, h long")
    own = f"__{uuid.uuid4().hex}"  # no column of docs has this name
    keys = written(places.join(known, "h", "left_semi").select(F.col("key").alias(own)).distinct(), "decontaminate-keys")
    small = F.broadcast(keys) if bounded(keys, BROADCAST_ROWS) else keys
    return docs.join(small, F.col(f"`{key}`") == F.col(own), "left_semi").unionByName(docs.where(F.col(f"`{key}`").isNull()))


OVERLAPS = "item_id long, start long, item_start long, n_words long, n_matched long"


def narrowed(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, block_words: int) -> tuple[DataFrame, Iterator[Block]]:
    """docs, or where the items make several blocks those that have a seed of any; and the blocks."""
    found = blocks(items, item_key, item_text, block_words)
    some = list(islice(found, 2))
    if len(some) > 1:
        docs = written(seeded(docs, items, key, text, item_text), "decontaminate-some")
    return docs, chain(some, found)


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and benchmark item that overlap: the best stretch, in words."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {OVERLAPS}"
    out = spark.createDataFrame([], schema)
    some, parts = narrowed(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text")), items, key, "text", item_key, item_text, block_words)
    for block in parts:
        shared = packed(spark, block)

        def run(found: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = unpacked(shared)
            for batch in batches(found, BATCH_BYTES):
                hits = block.overlaps(texts(batch))
                if hits:
                    at, item, *rest = (np.array(x) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([block.ids[i] for i in item], pa.int64()), *[pa.array(x, pa.int64()) for x in rest]], [key, "item_id", "start", "item_start", "n_words", "n_matched"])

        out = out.unionByName(some.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that overlap no benchmark item, all columns as they are.

    A benchmark of one block takes one scan and no shuffle. A larger one is met by the documents that
    have a seed of it, block by block; the others are those that a join on them leaves.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text)
    some, parts = narrowed(docs, items, key, text, item_key, item_text, block_words)
    whole, out = some is docs, some
    for block in parts:
        shared = packed(spark, block)

        def run(found: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = unpacked(shared)
            for batch in batches(found, BATCH_BYTES, text):
                bad = {x[0] for x in block.overlaps([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()])}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        if not whole:  # one block at a time in a worker's memory
            out = written(out, "decontaminate-left")
    if whole:
        return out
    own = f"__{uuid.uuid4().hex}"
    seen = written(some.select(F.col(f"`{key}`").alias(own)).distinct(), "decontaminate-seen")
    small = F.broadcast(seen) if bounded(seen, BROADCAST_ROWS) else seen
    return docs.where(F.col(f"`{key}`").isNotNull()).join(small, F.col(f"`{key}`") == F.col(own), "left_anti").unionByName(out)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""SimHash near-duplicates by segment popcounts (operator 6).

A fingerprint has a bit set if it is set in over half of the XXH64 hashes of a text's word shingles.
Two fingerprints link at DISTANCE or fewer differing bits. Distinct fingerprints are embedded as 32
counts, the number of set bits in each 2-bit segment; the Manhattan distance of two embeddings is a
lower bound of the fingerprints' Hamming distance. The segments form BLOCKS sub-grids. Within
Manhattan distance DISTANCE at most that many of them differ, so two fingerprints that link agree in
every count of BLOCKS - DISTANCE sub-grids at least, and meet in the cell of some choice of so many: an
equi-join on cells, the whole Manhattan bound and the exact Hamming distance finish it. Of random
fingerprints a share of 4e-4 of all pairs meets in the cells of 6 sub-grids, 1e-5 in those of 8 and
1e-6 in those of 10, so their number follows that of the distinct fingerprints; results don't depend
on it.

A dense cell (many variants of one text) is not joined with itself in full. Each member is first
compared with its cell's pivot; those links join most of a dense cell into one component, and only
members of different components are joined afterwards. That loses no component: a pair is left out
only if a path already joins it. Components are found by alternating large-star and small-star
steps on the links, the last FEW links by one task. Fingerprints, links and components stay distributed.

Defined results: a null or empty text has fingerprint zero and links as any other; repeated rows
have equal fingerprints and so one component; an empty table gives an empty table; other columns are
ignored, whatever their names. component_id is the smallest key of the component, null keys aside;
keys are whole numbers, other types raise. A very long text is a batch of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import MAP_BITS, batches, bitmap, bounded, documents, dropped, mapped, release, texts, whole_number, written

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Sub-grids by the number of distinct fingerprints: more make smaller cells, and more copies of each fingerprint.
BLOCKS = ((0, 6), (4_000_000, 8), (64_000_000, 10))
BATCH_BYTES = 4 << 20
#: Links that one task joins up by itself.
FEW = 200_000
LANES = np.uint64(0x0101010101010101)


def majorities(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes [k, n] the bits set in over half of them, as uint64 [k]."""
    k, n = hashes.shape
    rows = -(-n // 255)
    h = np.zeros((k, rows * 255), np.uint64)
    h[:, :n] = hashes
    h = h.reshape(k, rows, 255)
    out = np.zeros(k, np.uint64)
    for bit in range(8):  # a byte-wide counter for each of eight bits at once, 255 hashes at a time
        lanes = ((h >> np.uint64(bit)) & LANES).sum(2, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(k, rows, 8).sum(1, dtype=np.int64)
        out |= ((2 * counts > n).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(1, dtype=np.uint64)
    return out


def hashed(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; of fewer words the whole sequence's, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    return int(majorities(hashes[None])[0]) if len(hashes) else 0


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(hashed(text, shingle))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (the fingerprint as a signed long)."""
    kind = df.schema[key].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, BATCH_BYTES):
            fps = np.array([fingerprint(x, shingle) for x in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def embedding(fp: Column) -> Column:
    """A long with the count of each 2-bit segment (0, 1, 2) in the segment's two bits."""
    low = F.lit(0x5555555555555555)
    one, two = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return one.bitwiseXOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))  # their sum, without a signed overflow


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings: over 2-bit fields, |x - y| is 2 where 0 meets 2, and 1 where one of x, y is odd."""
    low = F.lit(0x5555555555555555)
    xor = a.bitwiseXOR(b)
    odd, high = xor.bitwiseAND(low), F.shiftrightunsigned(xor, 1).bitwiseAND(low)
    # counts 0, 1, 2 are 00, 01, 10: 0 against 2 differs in the high bit alone, 1 against 0 in the low, 1 against 2 in both
    return F.bit_count(odd) + 2 * F.bit_count(high.bitwiseAND(odd.bitwiseXOR(low)))


def cells(nodes: DataFrame, blocks: int = BLOCKS[0][1], distance: int = DISTANCE) -> DataFrame:
    """nodes (node, fp, ...) once for each choice of blocks - distance of the sub-grids, with the cell in them."""
    e = embedding(F.col("fp"))
    bounds = [round(32 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(3 << (2 * s) for s in range(bounds[i], bounds[i + 1])) for i in range(blocks)]
    chosen = [_signed(sum(masks[i] for i in some)) for some in combinations(range(blocks), blocks - distance)]
    return nodes.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("pair"), e.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(chosen)])))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close(a: Column, b: Column, distance: int) -> Column:
    return (manhattan(embedding(a), embedding(b)) <= distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node, root (the smallest node that links lead to) for every node of links (a, b: longs).

    Alternating large-star and small-star steps (every neighbour to the smallest one) shorten the
    links until no link changes, in O(log^2 n) rounds; each round's links are written, since they
    are read twice and must outlive executors. A hub's neighbours meet in a plain join and a map-side
    aggregated minimum. As soon as at most FEW links are left one task ends it by union-find.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    mark = None
    while not bounded(links, FEW):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), tag)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), tag)
        dropped(links, large)
        links, last = new, mark
        mark = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return links.coalesce(1).mapInArrow(joined_up, "node long, root long")


def joined_up(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of a few links (u, v), by union-find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in found:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], ["node", "root"])


def linked(nodes: DataFrame, cells_of: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column], check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node, fp, root (the smallest node of its component); nodes (node, fp, ...) is a written table, fp what near() compares.

    cells_of gives each node the cells (pair, cell) in which it can meet those it links to. Of pairs (a, b) that are near,
    check gives those that link, where not all do.
    """
    grid = cells_of(nodes).select("node", "fp", "pair", "cell")
    pivots = grid.groupBy("pair", "cell").agg(F.min_by("fp", "node").alias("pivot_fp"), F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = grid.join(pivots.drop("n"), ["pair", "cell"]).where((F.col("node") != F.col("pivot")) & near(F.col("fp"), F.col("pivot_fp")))
    stars = stars.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = written(components(check(stars) if check else stars), "simhash-first")
    # The same cells, with what the pivots have joined; cells of one component need no more.
    held = written(nodes.join(first, "node", "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "node").alias("root")), "simhash-held")
    open_ = cells_of(held).select("node", "root", "fp", "pair", "cell")
    mixed = open_.groupBy("pair", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("pair", "cell")
    open_ = open_.join(mixed, ["pair", "cell"], "left_semi")
    a, b = open_.alias("a"), open_.alias("b")
    on = (F.col("a.pair") == F.col("b.pair")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.root") < F.col("b.root")) & near(F.col("a.fp"), F.col("b.fp"))
    ends = "node" if check else "root"
    across = a.join(b, on).select(F.col(f"a.{ends}").alias("a"), F.col(f"b.{ends}").alias("b")).distinct()
    if check:
        across = between(check(across), held)
    final = written(components(across).select(F.col("node").alias("root"), F.col("root").alias("top")), "simhash-final")
    return held.join(final, "root", "left").select("node", "fp", F.coalesce("top", "root").alias("root"))


def between(links: DataFrame, roots: DataFrame) -> DataFrame:
    """links (a, b: nodes) as links of their roots; roots (node, root) has every node."""
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    return links.join(root_of("a"), "a").join(root_of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """key, fp, root (the smallest key reachable over links) for each row of df."""
    whole_number(df, key)
    if not 0 <= distance < BLOCKS[0][1]:
        raise ValueError(f"{BLOCKS[0][1]} sub-grids find links below distance {BLOCKS[0][1]}")
    prints = written(fingerprints(df, key, text, shingle), "simhash-prints")
    least = written(prints.where("key is not null").groupBy("fp").agg(F.min("key").alias("key")), "simhash-least")
    nodes = least.select(F.col("fp").alias("node"), "fp")
    n = least.count()
    blocks = max(k for most, k in BLOCKS if n >= most)
    found = written(linked(nodes, lambda x: cells(x, blocks, distance), lambda a, b: close(a, b, distance)).select("fp", F.col("root").alias("group")), "simhash-classes")
    found = written(rooted(least.join(found, "fp")).select("fp", "root"), "simhash-roots")
    release(df.sparkSession)
    return prints.join(found, "fp", "left").select(F.col("key").alias(key), "fp", "root")


def rooted(members: DataFrame) -> DataFrame:
    """members (group, key, ...) with root, the smallest key of the group."""
    return members.join(members.groupBy("group").agg(F.min("key").alias("root")), "group")


#: Texts are near-duplicates if their sets of distinct shingles have a Jaccard similarity of NEAR / OF or more.
NEAR, OF = 4, 5
#: Shingles that many texts share come last in the order of prefixes: one text in SAMPLE is counted for it.
SAMPLE = 16
#: Texts of the sample that share a shingle, for it to come last, and how many shingles may.
SHARED, MOST_SHARED = 3, 500_000
#: Bits of a map of shingles for each of them, and at most in all: 32 MB.
SHINGLE_BITS, MOST_BITS = 16, 28
#: The upper bits of a shingle by which shingles are counted: more than any map tells apart.
COUNTED_BITS = 40
#: Rows of which some are chosen by a broadcast bit for each, 16 MB in all; of more, by a join that shuffles all their shingles.
MOST_CHOSEN = 1 << 26


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of the distinct shingles, in order."""
    return np.unique(hashed(text, shingle).view(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit or more for each of a set's hashes, in longs: whether an odd number of them falls on the bit.

    Sketches of two sets differ in no more bits than the sets in elements; one of twice the length folds onto the half.
    """
    longs = 1 << max(0, (len(hashes) - 1) // 64).bit_length()
    bits = np.bincount(hashes & (64 * longs - 1), minlength=64 * longs).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of sketches a [k, m] and b [k, n] the bits that differ, the longer ones folded."""
    fold = min(a.shape[1], b.shape[1])
    a, b = (np.bitwise_xor.reduce(x.reshape(len(x), -1, fold), axis=1) for x in (a, b))
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(1, dtype=np.int64)


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b: nodes) that sizes and sketches of sets (node, n, sketch) don't rule out; no similar pair is."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            at = np.flatnonzero(OF * np.minimum(n, m) >= NEAR * np.maximum(n, m))
            lists = [batch.column(k).take(pa.array(at)) for k in (4, 5)]
            flat = [x.flatten().to_numpy() for x in lists]
            sizes = [np.asarray(x.value_lengths()).astype(np.int64) for x in lists]
            starts = [np.cumsum(x) - x for x in sizes]
            ok = np.zeros(len(at), bool)
            for p, q in set(zip(*(x.tolist() for x in sizes), strict=True)):
                some = np.flatnonzero((sizes[0] == p) & (sizes[1] == q))
                a, b = (flat[k][starts[k][some][:, None] + np.arange(w)] for k, w in ((0, p), (1, q)))
                # of n + m elements NEAR / OF leaves (OF - NEAR) / (OF + NEAR) to differ
                ok[some] = (OF + NEAR) * apart(a, b) <= (OF - NEAR) * (n + m)[at[some]]
            keep = pa.array(at[ok])
            yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1)], ["a", "b"])

    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def common_shingles(df: DataFrame, key: str, text: str, shingle: int) -> np.ndarray:
    """The most shared shingles of a sample, sorted by hash. Only the order of prefixes depends on them, no result."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, BATCH_BYTES):
            each, n = np.unique(np.concatenate([shingles(x, shingle) for x in set(texts(batch))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n.astype(np.int64))], ["token", "n"])

    some = df.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0).select(F.col(text).alias("text"))
    counts = some.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED)
    top = counts.orderBy(F.desc("n"), "token").limit(MOST_SHARED).select("token").toPandas()
    return np.sort(top.token.to_numpy(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set in the order of all shingles, those of common last.

    Of two sets with that similarity the prefixes have a shingle in common, the first of all they share.
    """
    n = len(hashes)
    if not n:
        return hashes
    last = np.isin(hashes, common, assume_unique=True) if len(common) else np.zeros(n, bool)
    return np.concatenate([hashes[~last], hashes[last]])[: n - -(-NEAR * n // OF) + 1]


def enough(both: Column, a: Column, b: Column) -> Column:
    """Whether `both` shared shingles of sets of a and b make a similarity of NEAR / OF."""
    return OF * both >= NEAR * (a + b - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b: nodes) whose sets (node, hashes) are similar, by all their shingles."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    return both.where(enough(F.size(F.array_intersect("ha", "hb")), F.size("ha"), F.size("hb"))).select("a", "b")


def row_bits(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the runs of 64 rows that have any of rows (row: distinct longs), in order, and a bit in each for those."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    found = rows.select(F.shiftright("row", 6).alias("run"), bit.alias("bit")).groupBy("run").agg(F.bit_or("bit").alias("bits")).toArrow()
    runs, bits = found["run"].to_numpy(), found["bits"].to_numpy()
    order = np.argsort(runs)
    return runs[order], bits[order]


def in_rows(chosen: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Whether row_bits() has each of rows."""
    runs, bits = chosen
    if not len(runs):
        return np.zeros(len(rows), bool)
    at = np.minimum(np.searchsorted(runs, rows >> 6), len(runs) - 1)
    return (runs[at] == rows >> 6) & (bits[at] >> (rows & 63) & 1 != 0)


def chosen(prints: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of prints (row, ...) that sets (row) name. What they hold is not shuffled, up to MOST_CHOSEN rows."""
    if prints.count() > MOST_CHOSEN:
        return prints.join(sets.select("row"), "row")
    shared = prints.sparkSession.sparkContext.broadcast(row_bits(sets))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.take(pa.array(np.flatnonzero(in_rows(shared.value, batch.column(0).to_numpy()))))

    prints = prints.select("row", *[c for c in prints.columns if c != "row"])
    return prints.mapInArrow(run, prints.schema)


def shingle_map(tokens: DataFrame) -> np.ndarray:
    """bitmap() of a written table of shingles, with bits by their number."""
    return bitmap(tokens, min(MOST_BITS, max(MAP_BITS, (SHINGLE_BITS * tokens.count()).bit_length())))


def numbered(sets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """sets (digest, key, row) with node, a number of each: its key, or for further sets of a key one that is no key.

    Numbers in the order of keys make the earliest text of a cell its pivot. rows (key, row, ...), if given, get
    the numbers that sets have.
    """
    rows = sets if rows is None else rows
    again = written(sets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1").select("key", "first"), "similar-again")
    node = F.col("key").cast("long")
    if not again.limit(1).count():
        return rows.withColumn("node", node)
    low, high, last = sets.agg(F.min(node), F.max(node), F.max("row")).first()
    if low - last - 1 >= -(1 << 63):
        other = F.lit(low) - 1 - F.col("row")
    elif high + last + 1 < 1 << 63:
        other = F.lit(high) + 1 + F.col("row")
    else:
        raise ValueError("keys take up all whole numbers")
    again = F.broadcast(again) if bounded(again, FEW) else again
    return rows.join(again, "key", "left").withColumn("node", F.when(F.col("first").isNull() | (F.col("first") == F.col("row")), node).otherwise(other)).drop("first")


def grouped(df: DataFrame, key: str, text: str, shingle: int, made_tables: list[DataFrame] | None = None) -> DataFrame:
    """key, t (xxhash64 of the text), group, root (its smallest key) for each row: texts that links of a similarity of 0.8 or more join.

    Exact: equal sets are found by digest. Others meet by their SimHash fingerprints in the cells of segment
    counts, as in near_duplicates(); pairs within DISTANCE bits are verified. What is similar at more bits shares
    a shingle of the prefixes: an equi-join on those that several groups have brings their sets together,
    and the sizes and the shingles left behind the shared one rule out pairs that can't reach the similarity. Of
    all candidates sketches leave those that may, and these are verified by their whole sets, made again from
    their texts alone. As in linked(), a cell's members are compared with its pivot first, and only members of
    different components with each other. made_tables gets the tables that nothing reads once the result is written.
    """
    spark, kind = df.sparkSession, whole_number(df, key)
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    common = spark.sparkContext.broadcast(common_shingles(df, key, text, shingle))

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))

    digested = lambda sets: pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())

    def made(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches(found, BATCH_BYTES):
            hashes = [hashed(x, shingle) for x in texts(batch)]
            fps = pa.array(np.array([majority(x) for x in hashes], np.uint64).view(np.int64))
            sets = [np.unique(x.view(np.int64)) for x in hashes]
            sizes = pa.array([len(x) for x in sets], pa.int32())
            rows = pa.array(row + np.arange(len(sets)))
            row += len(sets)
            columns = [batch.column(0), batch.column(2), rows, digested(sets), sizes, fps, lists([sketch(x) for x in sets]), lists([prefix(x, common.value) for x in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "t", "row", "digest", "n", "fp", "sketch", "hashes"])

    def whole(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, BATCH_BYTES):
            sets = [shingles(x, shingle) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), digested(sets), lists(sets)], ["key", "digest", "hashes"])

    prints = written(docs.mapInArrow(made, f"key {kind}, t long, row long, digest binary, n int, fp long, sketch array<long>, hashes array<long>"), "similar-prints")
    common.destroy()
    sets_ = written(prints.where("key is not null").groupBy("digest").agg(F.min("key").alias("key"), F.min_by("row", "key").alias("row")), "similar-nodes")
    nodes = numbered(sets_)
    own = chosen(prints.select("row", "key", "n", "fp", "sketch", "hashes"), sets_)
    own = written(numbered(sets_, own).select("node", "n", "fp", "sketch", "hashes"), "similar-own")
    names = written(prints.select("key", "t", "digest"), "similar-names")
    dropped(prints)
    tables = [names, sets_, own]

    def check(pairs: DataFrame) -> DataFrame:
        left = written(possible(pairs, own), "similar-possible")
        some = written(nodes.join(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "similar-some")
        small = F.broadcast if bounded(some, FEW) else lambda x: x  # or whole texts and their sets are shuffled
        sets = docs.join(small(some.select("key").distinct()), "key", "left_semi").mapInArrow(whole, f"key {kind}, digest binary, hashes array<long>")
        sets = written(sets.join(small(some), ["key", "digest"]).dropDuplicates(["node"]).select("node", "hashes"), "similar-sets")
        links = written(verified(left, sets), "similar-links")
        dropped(left, some, sets)
        tables.append(links)
        return links

    prints_of = own.select("node", "fp")
    n = own.count()
    blocks = max(k for most, k in BLOCKS if n >= most)
    found = written(linked(prints_of, lambda x: cells(x, blocks), lambda a, b: close(a, b, DISTANCE), check).select("node", "root"), "similar-close")

    def moved(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """rows (node, ...) with root; roots (node, root) has every node, of which only those that aren't their own root travel."""
        some = roots.where("root <> node")
        some = F.broadcast(some) if bounded(some, FEW) else some
        return rows.join(some, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def met(known: Broadcast) -> DataFrame:
        """token, node, n, at, root for what the prefixes have of the shingles that a map was made of, and for a few others."""

        def shared(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                column = batch.column(2)
                tokens, stops = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
                at = np.flatnonzero(mapped(known.value, tokens))
                row = np.searchsorted(stops, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(tokens[at]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((at - stops[row]).astype(np.int32))], ["token", "node", "n", "at"])

        return moved(own.select("node", "n", "hashes").mapInArrow(shared, "token long, node long, n int, at int"), found)

    # Shingles of several sets first, by bits that compress; of those, the ones that sets of several groups have.
    upper = F.col("token").bitwiseAND(F.lit(_signed((1 << 64) - (1 << (64 - COUNTED_BITS)))))
    several = own.select(F.explode("hashes").alias("token")).groupBy(upper.alias("token")).agg(F.count(F.lit(1)).alias("times"))
    several = written(several.where("times > 1").select("token"), "similar-several-shingles")
    known = spark.sparkContext.broadcast(shingle_map(several))
    mixed = met(known).groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    mixed = written(mixed, "similar-mixed-shingles")
    known.destroy()
    known = spark.sparkContext.broadcast(shingle_map(mixed))
    grid = written(met(known), "similar-grid")
    known.destroy()
    dropped(several, mixed)
    # What two sets can share at most, if the shingle they meet in is the first they share.
    most = lambda a, b: F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    able = enough(most("a", "b"), F.col("a.n"), F.col("b.n"))
    pivots = grid.groupBy("token").agg(F.min(F.struct("node", "n", "at", "root")).alias("p")).select("token", "p.*")
    a, b = grid.alias("a"), pivots.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & able)
    stars = written(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "similar-stars")
    tables.append(stars)

    def joined(links: DataFrame, roots: DataFrame) -> DataFrame:
        """roots (node, root) with what links of their nodes join."""
        top = components(between(links, roots)).select(F.col("node").alias("root"), F.col("root").alias("top"))
        return written(roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "similar-joined")

    first = joined(check(stars), found)
    held = written(moved(grid.drop("root"), first), "similar-held")
    dropped(grid)
    mixed = held.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    open_ = held.join(mixed, "token", "left_semi")
    a, b = open_.alias("a"), open_.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") < F.col("b.root")) & able)
    pairs = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    known = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    final = joined(check(pairs.join(known, ["a", "b"], "left_anti")), first)
    groups = nodes.join(final, "node").select("digest", "key", F.col("root").alias("group"))
    classes = written(rooted(groups).select("digest", "group", "root"), "similar-classes")
    dropped(held)
    if made_tables is not None:
        made_tables += [*tables, found, first, final, classes]
    release(spark)
    return names.join(classes, "digest", "left").select("key", "t", "group", "root")


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """key, root (the smallest key of its group) for each row: groups of texts that links of a similarity of 0.8 or more join."""
    return grouped(df, key, text, shingle).select(F.col("key").alias(key), "root")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """A row of df for each group of similar(): of the smallest key, then of the least hash of the text, then of all columns.

    Rows of null key stay. Where no key repeats, a semi-join on it is all that whole rows go through.
    """
    spark = df.sparkSession
    tables: list[DataFrame] = []
    groups = written(grouped(df, key, text, shingle, tables).where("key is not null"), "similar-groups")
    dropped(*tables)
    own = f"__{uuid.uuid4().hex}"  # no column of df has this name
    k, t, h = (f"{own}_{x}" for x in "kth")
    first = groups.where(F.col("key") == F.col("root")).groupBy("group").agg(F.min("key").alias(k), F.min("t").alias(t))
    several = written(groups.groupBy(F.col("key").alias(k)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(k), "similar-several")
    small = F.broadcast(several) if bounded(several, FEW) else several
    stay = written(first.join(small, k, "left_anti").select(k), "similar-stay")
    first = written(first.join(small, k, "left_semi"), "similar-first-rows")
    dropped(groups)
    kept = df.join(F.broadcast(stay) if bounded(stay, FEW) else stay, F.col(f"`{key}`") == F.col(k), "left_semi").unionByName(df.where(F.col(f"`{key}`").isNull()))
    if several.limit(1).count():
        hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
        again = df.join(small, F.col(f"`{key}`") == F.col(k), "left_semi").withColumns({k: F.col(f"`{key}`"), t: F.xxhash64(f"`{text}`"), h: F.xxhash64(*hashed)})
        again = again.join(first.select(k, t).distinct(), [k, t], "left_semi")
        best = again.groupBy(k, t).agg(F.min(h).alias(h))
        kept = kept.unionByName(again.join(best, [k, t, h], "left_semi").dropDuplicates([k, t, h]).select(df.columns))
    return kept


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("root").alias("component_id"))

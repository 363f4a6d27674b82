"""Removal of byte strings that an earlier document has, by sorted suffixes (operator 2).

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller key.
Texts that equal an earlier document's are found by their digests first. In the others, anchors are
the SEED-byte strings with the least hash in some run of REACH consecutive places; two equal
LENGTH-byte strings select the same anchors, so every match contains a place where an anchor meets
its equal. Anchors of more than one document are found by an aggregation on their hashes; a bitmap of
those, of BITMAP_BITS bits whatever the input, is broadcast and lets a second scan skip most others
(a false hit costs a row, never a result). An anchor whose surroundings an earlier document of the same
task has too is settled there.

The suffixes at anchors, LENGTH bytes long, and the reversed REACH - 1 bytes before them are then
sorted per anchor by deep-shallow sorting: multikey quicksort by eight-byte characters down to
SHALLOW bytes, the rounds of all anchors' partitions together, and a blind trie (only branching depths and bytes
are stored; one comparison with a leaf finds the place) for each group that still shares its prefix.
The sorts give the common prefix lengths of neighbours; for each a < REACH, rows equal in a bytes
before and LENGTH - a bytes from the anchor on form classes, and all but the smallest document of a
class have an earlier copy of that window.

Defined results: a null text is empty; documents of equal key don't remove from each other; a null
key neither removes nor loses anything; repeated rows (equal key and text) get equal results; an
empty table gives an empty table; other columns are ignored, whatever their names. Keys are whole
numbers; other types raise. A very long text is hashed in pieces and its row is one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import batches, bounded, cleared, documents, joined, release, texts, whole_number, written

LENGTH = 50
SEED = 20
REACH = LENGTH - SEED + 1
SHALLOW = 16
#: Bits of the bitmap for each anchor that several documents have, and at most in all (a power of 2): 64 MB.
ANCHOR_BITS, MOST_BITS = 16, 29
#: Bits of the bitmap that one row brings to the driver.
CHUNK_BITS = 18
#: Rows of exact copies up to which their keys are broadcast; above, the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of text hashed at a time: the arrays stay in a core's cache.
PIECE_BYTES = 1 << 17
#: Surroundings of anchors that a task remembers.
SEEN = 1 << 19
#: Rows of anchors sorted at a time, and more where one anchor has more.
BLOCK_ROWS = 1 << 16
LEFT, RIGHT = 32, 56  # bytes kept before and from an anchor on, in whole eight-byte characters

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def slide(values: np.ndarray, width: int, take) -> np.ndarray:
    """take (np.minimum, np.maximum) over each run of width values; shorter by width - 1."""
    out, size = values, 1
    while 2 * size <= width:
        out = take(out[:-size], out[size:])
        size *= 2
    if size < width:
        out = take(out[: len(out) - (width - size)], out[width - size :])
    return out


def anchors(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of the anchors of all texts: places that are the least in a window of REACH within their text."""
    buffer, starts, lengths = joined(parts, LENGTH + 16)
    n = len(buffer) - LENGTH - 16
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.ndarray((n + SEED,), "<u8", buffer, 0, (1,)).copy()
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at, factor in ((8, 0xD6E8FEB86659FD93), (SEED - 8, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(29)
        h += words[at : at + n] * np.uint64(factor)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    # Windows that run over the end of their text select nothing.
    least = np.zeros(n, np.uint64)
    inner = slide(h, REACH, np.minimum)
    least[: len(inner)] = inner
    for i in range(1, LENGTH):
        ends = starts + lengths - i
        least[ends[(lengths >= i)]] = 0
    padded = np.concatenate([np.zeros(REACH - 1, np.uint64), least])
    at = np.flatnonzero((slide(padded, REACH, np.maximum) == h) & (h > 0))
    text = np.searchsorted(starts, at, "right") - 1
    return h[at], text, at - starts[text]


def pieces(parts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, held = 0, 0
    for i, x in enumerate(parts):
        held += len(x)
        if held >= PIECE_BYTES:
            yield start, parts[start : i + 1]
            start, held = i + 1, 0
    if start < len(parts):
        yield start, parts[start:]


class BlindTrie:
    """Distinct strings of one length in order, by branching depths and bytes alone.

    A node is a leaf (a string) or a list [depth, {byte: node}]. To insert, follow the branching bytes
    to some leaf, compare with it once for the true common prefix, and branch where that ends.
    """

    def __init__(self) -> None:
        self.root = None

    def insert(self, string: bytes) -> None:
        if self.root is None:
            self.root = string
            return
        node = self.root
        while type(node) is list:
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        common = shared(node, string)
        if common == len(string):
            return
        above, edge, at = None, 0, self.root
        while type(at) is list and at[0] < common:
            above, edge = at, string[at[0]]
            at = at[1][edge]
        if type(at) is list and at[0] == common:
            at[1][string[common]] = string
            return
        fresh = [common, {node[common]: at, string[common]: string}]
        if above is None:
            self.root = fresh
        else:
            above[1][edge] = fresh

    def ordered(self) -> Iterator[tuple[bytes, int]]:
        """Strings in order, each with its common prefix with the one before (0 for the first)."""
        stack = [(self.root, 0)] if self.root is not None else []
        while stack:
            node, common = stack.pop()
            if type(node) is list:
                depth, children = node
                edges = sorted(children)
                stack += [(children[e], depth) for e in edges[:0:-1]]
                stack.append((children[edges[0]], common))
            else:
                yield node, common


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    return len(a) - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7 >> 3)


def multikey_quicksort(order: np.ndarray, characters: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
    """Sort order[begin:end] of each segment by the rows' first SHALLOW bytes, eight at a time, in place.

    A round takes all open segments: each is parted by a pivot of its own, the middle one of three, into
    smaller, equal and larger rows; smaller and larger ones stay at their character, equal ones go on
    with the next.
    """
    depths = np.zeros(len(begins), np.int64)
    while True:
        open_ = (ends - begins > 1) & (depths < SHALLOW)
        begins, ends, depths = begins[open_], ends[open_], depths[open_]
        if not len(begins):
            return
        sizes = ends - begins
        first = np.cumsum(sizes) - sizes
        segment = np.repeat(np.arange(len(begins)), sizes)
        places = np.arange(len(segment)) + (begins - first)[segment]
        rows = order[places]
        keys = characters[rows, depths[segment] // 8].astype(np.uint64)
        a, b, c = keys[first], keys[first + sizes // 2], keys[first + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        side = (keys >= pivot).astype(np.int64) + (keys > pivot)
        counts = np.bincount(segment * 3 + side, minlength=3 * len(begins)).reshape(-1, 3)
        starts = begins[:, None] + np.cumsum(counts, axis=1) - counts
        for k in range(3):
            own = side == k
            rank = np.cumsum(own)
            before = np.append(0, rank)[first]
            order[starts[segment[own], k] + rank[own] - 1 - before[segment[own]]] = rows[own]
        begins, ends = starts.ravel(), (starts + counts).ravel()
        depths = (depths[:, None] + np.array([0, 8, 0])).ravel()


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by (group, string) and the common prefix of each with the row before, -1 where a group begins.

    strings: uint8 [rows, width], width a multiple of 8; group: integers, equal for rows that are sorted together.
    """
    n, width = strings.shape
    order = np.argsort(group, kind="stable")
    common = np.full(n, width, np.int64)
    ordered = group[order]
    common[:1] = -1
    common[1:][ordered[1:] != ordered[:-1]] = -1
    characters = np.ascontiguousarray(strings).view(">u8")
    begins = np.flatnonzero(common < 0)
    multikey_quicksort(order, characters, begins, np.append(begins[1:], n))
    for depth in range(SHALLOW - 8, -8, -8):
        keys = characters[order, depth // 8].astype(np.uint64)
        bits = keys[1:] ^ keys[:-1]
        prefix = depth + sum((bits >> np.uint64(64 - 8 * k)) == 0 for k in range(1, 8))
        common[1:] = np.where((common[1:] < 0) | (bits == 0), common[1:], prefix)
    begins = np.flatnonzero(common < SHALLOW)
    ends = np.append(begins[1:], n)
    rest = strings[:, SHALLOW:].copy()
    raw, step = rest.tobytes(), width - SHALLOW
    for begin, end in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
        rows: dict[bytes, list[int]] = {}
        for r in order[begin:end].tolist():
            rows.setdefault(raw[r * step : r * step + step], []).append(r)
        if len(rows) == 1:
            continue
        trie = BlindTrie()
        for x in rows:
            trie.insert(x)
        at = begin
        for x, c in trie.ordered():
            same = rows[x]
            if at > begin:
                common[at] = SHALLOW + c
            order[at : at + len(same)] = same
            common[at + 1 : at + len(same)] = width
            at += len(same)
    return order, common


def earlier(hashes: np.ndarray, keys: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least and largest a for which its window that begins a bytes before the anchor has a copy in a
    row of equal hash and smaller key; -1 where none has. Rows of equal hash are in the order of their keys."""
    n = len(hashes)
    least, most = np.full(n, -1), np.full(n, -1)
    if not n:
        return least, most
    starts = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    group = np.cumsum(starts)
    sizes = np.bincount(group)[group]
    rows = np.flatnonzero(sizes > 1)  # false hits of the bitmap and anchors with a single row are done
    if not len(rows):
        return least, most
    group = group[rows]
    sides = [deep_shallow(group, strings[rows]) for strings in (left, right)]

    def ranks(side: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
        order, common = side
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.cumsum(common < depth) if depth else np.cumsum(common < 0)
        return rank

    def classes(labels: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The smallest key in each row's class."""
        by = np.argsort(labels, kind="stable")  # keys of a group ascend
        new = np.concatenate([[True], labels[by][1:] != labels[by][:-1]])
        out = np.empty(len(at), keys.dtype)
        out[by] = keys[rows[at[by]]][np.flatnonzero(new)][np.cumsum(new) - 1]
        return out

    # A row whose whole context an earlier document has, has an earlier copy of each of its windows.
    everywhere = np.arange(len(rows))
    label = (ranks(sides[0], left.shape[1]) * (len(rows) + 1) + ranks(sides[1], right.shape[1])) * 64 + n_left[rows]
    whole = keys[rows] > classes(label * 64 + n_right[rows], everywhere)
    long = rows[whole & (n_left[rows] + n_right[rows] >= LENGTH)]
    most[long] = np.minimum(n_left[long], LENGTH - SEED)
    least[long] = np.maximum(LENGTH - n_right[long], 0)
    open_ = everywhere[~whole]
    for a in range(REACH):
        fits = open_[(n_left[rows[open_]] >= a) & (n_right[rows[open_]] >= LENGTH - a)]
        if len(fits):
            label = ranks(sides[0], a)[fits] * (len(rows) + 1) + ranks(sides[1], LENGTH - a)[fits]
            hit = rows[fits[keys[rows[fits]] > classes(label, fits)]]
            most[hit] = a
            least[hit[least[hit] < 0]] = a
    return least, most


def fixed(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width)


def blocks(found: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that are sorted by column, of BLOCK_ROWS rows or one group."""
    held, rows = [], 0
    for batch in found:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            values = table.column(column).to_numpy()
            cut = int(np.searchsorted(values, values[-1], "left"))
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut).combine_chunks()
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, t (xxhash64 of the text), spans (array of start, stop): what goes, overlapping as found."""
    spark = docs.sparkSession
    whole_number(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("key is not null").where(F.octet_length("text") >= LENGTH)
    rows = rows.withColumn("t", F.xxhash64("text"))
    prints = rows.select("key", "t", F.octet_length("text").alias("n"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    same = prints.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first")
    copies = written(prints.join(same, "digest").where(F.col("key") > F.col("first")).select("key", "t", "n").distinct(), "suffix-copies")
    known = copies.select("key", "t")
    single = rows.join(F.broadcast(known) if bounded(known, BROADCAST_ROWS) else known, ["key", "t"], "left_anti")

    def mark(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, 1 << 21):
            keys, parts = batch.column(0).to_numpy(), texts(batch)
            for start, some in pieces(parts):
                h, text, _ = anchors(some)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[start + text])], ["h", "key"])

    marks = single.select("key", "text").mapInArrow(mark, "h long, key long")
    several = written(marks.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h"), "suffix-several")
    map_bits = min(MOST_BITS, max(CHUNK_BITS, (ANCHOR_BITS * several.count()).bit_length()))
    # Low bits choose the place: anchors are least hashes, whose high bits are nearly all 0.
    chunk = F.shiftright(F.col("h").bitwiseAND(F.lit((1 << map_bits) - 1)), CHUNK_BITS).cast("int")

    def fill(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, np.ndarray] = {}
        for batch in found:
            at, which = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << CHUNK_BITS) - 1), batch.column(1).to_numpy()
            for c in np.unique(which).tolist():
                own = at[which == c]
                np.bitwise_or.at(words.setdefault(c, np.zeros(1 << (CHUNK_BITS - 6), np.uint64)), own >> np.uint64(6), np.uint64(1) << (own & np.uint64(63)))
        for c, bits in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["chunk", "bits"])

    bitmap = np.zeros((1 << (map_bits - CHUNK_BITS), 1 << (CHUNK_BITS - 6)), np.uint64)
    with cleared(spark):
        for row in several.select("h", chunk.alias("chunk")).repartition("chunk").mapInArrow(fill, "chunk int, bits binary").toLocalIterator():
            bitmap[row.chunk] = np.frombuffer(row.bits, np.uint64)
    bitmap = bitmap.reshape(-1)
    shared_bits = spark.sparkContext.broadcast(bitmap)
    release(spark)

    def suffixes(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared_bits.value
        seen: dict[bytes, int] = {}  # the smallest key of each anchor with its surroundings, so far in this task
        for batch in batches(found, 1 << 21):
            keys, ts, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch)
            rows = []
            for start, some in pieces(parts):
                h, text, at = anchors(some)
                where = h & np.uint64((1 << map_bits) - 1)
                hit = np.flatnonzero((bits[where >> np.uint64(6)] >> (where & np.uint64(63))) & np.uint64(1))
                for x, i, p in zip(h[hit].view(np.int64).tolist(), text[hit].tolist(), at[hit].tolist(), strict=True):
                    data, key = some[i], keys[start + i]
                    left, right = data[max(0, p - REACH + 1) : p][::-1], data[p : p + LENGTH]
                    around = xxhash.xxh3_128_digest(b"%d %d " % (x, len(left)) + left + right)
                    first = seen.setdefault(around, key)
                    if first >= key:
                        seen[around] = key
                        rows.append((x, key, ts[start + i], p, 0, left, right))
                    elif len(left) + len(right) >= LENGTH:
                        # An earlier document of this task has all of it: the span is known, the suffix stays here.
                        low, high = max(LENGTH - len(right), 0), min(len(left), LENGTH - SEED)
                        rows.append(((key * 0x9E3779B97F4A7C15 + p + 2**63) % 2**64 - 2**63, key, ts[start + i], p - high, p - low + LENGTH, None, None))
            if len(seen) > SEEN:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["h", "key", "t", "at", "stop", "l", "r"])

    places = single.select("key", "t", "text").mapInArrow(suffixes, "h long, key long, t long, at int, stop int, l binary, r binary")

    def match(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = lambda *columns: pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "t", "start", "stop"])
        for table in blocks(found, "h"):
            open_ = table.column("l").is_valid().to_numpy()
            get = lambda c, which: table.column(c).to_numpy()[which]
            yield span(*[get(c, ~open_) for c in ("key", "t", "at", "stop")])
            some = table.filter(pa.array(open_))
            lefts, rights = some.column("l").to_pylist(), some.column("r").to_pylist()
            n_left, n_right = (np.fromiter(map(len, x), np.int64, len(x)) for x in (lefts, rights))
            least, most = earlier(get("h", open_), get("key", open_), fixed(lefts, LEFT), n_left, fixed(rights, RIGHT), n_right)
            hit = np.flatnonzero(most >= 0)
            key, t, at = (get(c, open_)[hit] for c in ("key", "t", "at"))
            yield span(key, t, (at - most[hit]).astype(np.int32), (at - least[hit] + LENGTH).astype(np.int32))

    spans = written(places.repartition("h").sortWithinPartitions("h", "key").mapInArrow(match, "key long, t long, start int, stop int"), "suffix-spans", rows=16384)  # rows of some hundred bytes at most
    release(spark)
    whole = copies.select("key", "t", F.lit(0).alias("start"), F.col("n").cast("int").alias("stop"))
    return spans.unionByName(whole).groupBy("key", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("key", key)


def cut(data: bytes, starts: list[int], stops: list[int]) -> tuple[bytes, int, int]:
    """What stays, how many bytes go, and in how many runs."""
    kept, gone, runs, at, reach = [], 0, 0, 0, -1
    for start, stop in sorted(zip(starts, stops, strict=True)):
        if start > reach or reach < 0:  # runs that touch are one run
            runs += 1
        if start > at:
            kept.append(data[at:start])
        if stop > at:
            gone += stop - max(at, start)
            at = stop
        reach = max(reach, stop)
    kept.append(data[at:])
    return b"".join(kept), gone, runs


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (binary) for each row of docs."""
    spark = docs.sparkSession
    found = repeats(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    rows = rows.join(found.withColumnRenamed(key, "k").withColumnRenamed("t", "u"), (F.col(key).cast("long") == F.col("k")) & (F.col("t") == F.col("u")), "left").select(F.col(key), "text", "spans")

    def apply(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(some, 1 << 22):
            out = []
            for data, spans in zip(texts(batch), batch.column(2).to_pylist(), strict=True):
                kept, gone, runs = cut(data, [x["start"] for x in spans or ()], [x["stop"] for x in spans or ()])
                out.append((len(data), gone, runs, kept))
            n, gone, runs, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, runs)], pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(apply, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = removed(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

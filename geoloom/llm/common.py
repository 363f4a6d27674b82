"""What the text operators share: scratch tables, word rules, stable hashes and batches."""

from __future__ import annotations

import contextlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these (fixed by the contracts).
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch: long texts must not make a batch of gigabytes.
BATCH_ROWS = 512
#: Bytes whose words are hashed at a time, or one word's: the arrays stay in a core's cache.
PIECE = 1 << 16
# Numbers of the word hash: any odd ones, and a random one for each byte.
BASE, MULTIPLIER = np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD6E8FEB86659FD93)
BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir; in local mode, where it is unset, one under the warehouse."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("executors need a shared folder for tables: set spark.checkpoint.dir")
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/geoloom"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.deleteOnExit(where)
    return path


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as its result is there: disks hold one step's shuffles at a time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside; the session's own number afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, tag: str, rows: int = BATCH_ROWS) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, outlives executors and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with cleared(spark), batch_rows(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by written() that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        root = scratch_root(spark)
        for name in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/geoloom/" in name and root.rpartition("/")[0].removeprefix("file://").removeprefix("file:") in name:
                where = spark._jvm.org.apache.hadoop.fs.Path(name)
                where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose results are written."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_number(df: DataFrame, key: str) -> str:
    """The type of a key that is compared as a long; others than whole numbers raise here, not in a task."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a whole number, not {kind}")
    return kind


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def joined(parts: list[bytes], pad: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All parts in one buffer with pad zero bytes behind it; where each starts; lengths."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths) - lengths
    return b"".join(parts) + bytes(pad), starts, lengths


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, A-Z lower-cased, one after another; words in each text.

    A word's hash is the polynomial of its bytes' numbers, taken from running sums of some words at a time.
    """
    data = b"\n".join([b"", *parts, b""]).lower()
    at = np.frombuffer(data, np.uint8)
    space = SPACE[at]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
    bounds = np.cumsum([1, *(len(x) + 1 for x in parts)])
    sizes = np.diff(np.searchsorted(starts, bounds))
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(stops, low + PIECE, "right")))
        a, b = starts[first:last] - low, stops[first:last] - low
        up, down = powers(int(b[-1]))
        sums = np.append(np.uint64(0), np.cumsum(BYTE[at[low : low + b[-1]]] * up[: b[-1]]))
        out[first:last] = (sums[b] - sums[a]) * down[a]
        first = last
    out = (out ^ (out >> np.uint64(32))) * MULTIPLIER
    return (out ^ (out >> np.uint64(29))).view(np.int64), sizes


#: Powers by their number, made once in a task.
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2^64, for n places or more."""
    n = max(PIECE, 1 << (n - 1).bit_length())
    if n not in POWERS:
        step = lambda x: np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64)))
        POWERS[n] = step(BASE), step(np.uint64(pow(int(BASE), -1, 1 << 64)))
    return POWERS[n]


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices whose text is at most most_bytes, or one row."""
    at_col = column
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(batch.schema.get_field_index(at_col))
        sizes = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
        start = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most_bytes, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def packed(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of this package's classes: pickled by value, as functions are."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def bounded(df: DataFrame, most: int) -> bool:
    """Whether a written table has at most so many rows, and so may be broadcast."""
    return df.limit(most + 1).count() <= most


#: Bits of the map that bitmap() makes unless told otherwise: 16 MB, whatever the number of hashes.
MAP_BITS = 27


def bitmap(hashes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """Bits at the upper `bits` of each hash (a column of uniform longs): those not in it are in no map of theirs."""
    c = F.col(hashes.columns[0])
    at = F.shiftrightunsigned(c, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    found = hashes.select(F.shiftrightunsigned(at, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def mapped(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the map has each of hashes (longs): True for all that it was made of, and a few others."""
    at = hashes.view(np.uint64) >> np.uint64(65 - (64 * len(bits)).bit_length())
    return bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64) & 1 != 0

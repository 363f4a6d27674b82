"""What a log of tile fetches says: outcomes, waits, failures, the cache, and which ranges of a file to ask for."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.cleaning import image_kind

c = F.col
# Fixed values of the fetch rules: the longest wait that a server may ask for, tries after the first, and the largest body.
LONGEST_WAIT, RETRIES, TIMEOUT_RETRIES, MOST_BYTES = 30, 3, 1, 4 << 20
#: Bytes of a block of a file that is read by ranges.
RANGE_BLOCK = 16 << 10


def retry_seconds(attempt: Column, asked: Column, step: float = 1.0) -> Column:
    """Wait before the next try (attempt counts from 0): what the server asks for, at most LONGEST_WAIT, else longer with each try."""
    return F.when(asked.isNotNull(), F.least(asked.cast("double"), F.lit(float(LONGEST_WAIT)))).otherwise((attempt + 1) * step)


def outcome(status: Column, body: Column, attempt: Column, problem: Column) -> Column:
    """'ok', 'retry' or 'failed' of one try; problem is null, 'timeout', 'network' or 'refused' (an address or redirect).

    An answer that is no image, too large, or an error of the request fails at once; too many requests,
    errors of the server and of the network are tried again RETRIES times, timeouts TIMEOUT_RETRIES times.
    """
    again = lambda most: F.when(attempt < most, "retry").otherwise("failed")
    fine = image_kind(body).isNotNull() & (F.octet_length(body) <= MOST_BYTES)
    return (
        F.when(problem == "refused", "failed").when(problem == "timeout", again(TIMEOUT_RETRIES)).when(problem.isNotNull(), again(RETRIES))
        .when(status.between(200, 299), F.when(F.coalesce(fine, F.lit(False)), "ok").otherwise("failed"))
        .when((status == 429) | (status >= 500), again(RETRIES)).otherwise("failed")
    )


def after_failure(policy: str) -> str:
    """What becomes of a tile that failed: an error, a missing tile, or a black one."""
    found = {"strict": "error", "lenient": "missing", "ignore": "black"}
    if policy not in found:
        raise ValueError(f"the policy is one of {', '.join(found)}, not {policy!r}")
    return found[policy]


def failed_ratio(log: DataFrame, by: Sequence[str], failed: Column, most: float) -> DataFrame:
    """by, failed, total of the groups whose share of failed fetches is over `most`."""
    found = log.groupBy(*by).agg(F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("total"))
    return found.where(c("failed") / c("total") > most)


def failure_summary(log: DataFrame, kind: str, example: str) -> DataFrame:
    """kind, n, the first example, and place by frequency: a row for each kind of failure."""
    found = log.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min(example).alias("example"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(c("n").desc(), kind)).cast("bigint"))  # kinds are few


def placeholders(tiles: DataFrame, known: DataFrame, body: str) -> DataFrame:
    """The tiles whose body is one of the known placeholders (size, sha256)."""
    with_digest = tiles.withColumns({"size": F.octet_length(body), "sha256": F.sha2(c(body).cast("binary"), 256)})
    return with_digest.join(known.select("size", "sha256").distinct(), ["size", "sha256"], "left_semi").select(tiles.columns)


def cache_usage(cached: DataFrame, seconds: str, age: float) -> DataFrame:
    """tiles, expired and refused of a cache: kept `seconds` each, null where it must not be kept."""
    return cached.agg(F.count(seconds).alias("tiles"), F.count_if(c(seconds) <= age).alias("expired"), F.count_if(c(seconds).isNull()).alias("refused"))


def fresh(cached: DataFrame, seconds: str, age: float) -> DataFrame:
    """What a cache still answers after `age` seconds, and what is left when expired entries are cleared."""
    return cached.where(c(seconds) > age)


def wanted(tiles: DataFrame, cached: DataFrame, keys: Sequence[str], seconds: str, age: float) -> DataFrame:
    """The tiles that no fresh entry answers."""
    return tiles.join(fresh(cached, seconds, age).select(*keys), list(keys), "left_anti")


def range_reads(requests: DataFrame, block: int = RANGE_BLOCK) -> DataFrame:
    """file, start, stop: the byte ranges to ask for, in whole blocks, each block once, adjacent ones as one.

    requests: file, offset, length of the bytes that are needed. A file's requests meet in one task, sorted,
    and are merged as a stream: what is sorted is a row for each request, and no block is held.
    """
    at = lambda byte: F.floor(byte / block).cast("bigint")
    rows = requests.where("length > 0").select("file", at(c("offset")).alias("start"), at(c("offset") + c("length") - 1).alias("last"))
    kind = rows.schema["file"].dataType.simpleString()

    def merge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["file", "start", "stop"], None
        for batch in found:
            if not batch.num_rows:
                continue
            file, start, last = batch.columns
            if held is not None:
                file, start, last = (pa.concat_arrays([x, y]) for x, y in zip(held, (file, start, last), strict=True))
            code = file.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first, levels = start.to_numpy(), np.unique(last.to_numpy(), return_inverse=True)
            other = code[1:] != code[:-1]
            own = np.append(0, np.cumsum(other)) * len(levels[0])
            until = levels[0][np.maximum.accumulate(levels[1] + own) - own]  # the last block so far of each file
            begins = np.flatnonzero(np.append(True, other | (first[1:] > until[:-1] + 1)))
            ends = np.append(begins[1:], len(first)) - 1
            held = (file.slice(begins[-1], 1), pa.array(first[begins[-1:]]), pa.array(until[ends[-1:]]))
            begins, ends = begins[:-1], ends[:-1]
            if len(begins):
                yield pa.RecordBatch.from_arrays([file.take(pa.array(begins)), pa.array(first[begins] * block), pa.array((until[ends] + 1) * block)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([held[0], pa.array(held[1].to_numpy() * block), pa.array((held[2].to_numpy() + 1) * block)], names)

    return rows.repartition("file").sortWithinPartitions("file", "start").mapInArrow(merge, f"file {kind}, start long, stop long")

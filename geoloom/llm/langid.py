"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 5).

A text is lower-cased and read as code points; characters that aren't letters count as one boundary
symbol. Its 1-, 2- and 3-grams that begin at or before a letter are hashed into BUCKETS. Training
counts (language, bucket) over all labelled training rows, added up in each task first. The matrix
of log-probabilities, at most MOST_LANGUAGES x BUCKETS floats, is broadcast; a batch is scored in
numpy by gathering and adding the rows of its n-grams. More languages are scored in blocks of so
many, one after another, each carrying on the best language and the sum of all blocks before.

Defined results: a null text, or one without a letter, gives `und` with score 0; a null label isn't
learned; if nothing was learned every text is `und`; ties go to the language that sorts first;
repeated rows count as often as they occur; an empty table gives an empty table; other columns are
ignored, whatever their names. A very long text is a batch of its own: its task needs some hundred
bytes for each of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import batches, batch_rows, documents, remainder, written

BITS = 15
BUCKETS = 1 << BITS
#: Languages in a block of the matrix: 16 MB.
MOST_LANGUAGES = 128
#: Added to each count.
ALPHA = 0.1
BATCH_BYTES = 1 << 20


def symbols(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, boundaries as 0, each text followed by two boundaries; where each starts."""
    parts = [(x or "").lower().encode("utf-32-le", "surrogatepass") + bytes(8) for x in values]
    sizes = np.fromiter((len(x) >> 2 for x in parts), np.int64, len(parts))
    points = np.frombuffer(b"".join(parts), np.uint32)
    letter = np.bincount(points) > 0
    for i in np.flatnonzero(letter).tolist():
        letter[i] = chr(i).isalpha()
    return np.where(letter[points], points, np.uint32(0)), np.cumsum(sizes) - sizes


def grams(points: np.ndarray) -> list[np.ndarray]:
    """For n = 1, 2, 3 the bucket of the n-gram at each place, BUCKETS where none counts."""
    after = lambda k: np.append(points[k:], np.zeros(k, np.uint32))
    one, two = after(1), after(2)
    first, either = points > 0, (points > 0) | (one > 0)
    out, h = [], points * np.uint32(0x9E3779B1) + np.uint32(1)
    for more, mask in ((None, first), (one * np.uint32(0x85EBCA77), either), (two * np.uint32(0xC2B2AE3D), either)):
        h = h if more is None else h + more + np.uint32(1)
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
        out.append(np.where(mask, x >> np.uint32(32 - BITS), np.uint32(BUCKETS)))
    return out


@dataclass
class Model:
    """Languages in order, their counts (number, bucket, n; bucket BUCKETS has the texts) and all texts."""

    names: list[str]
    sums: DataFrame
    texts: int

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """Languages, and log-probabilities [BUCKETS + 2, languages]: the last row but one is 0, of no n-gram; the last is the log prior."""
        for first in range(0, max(1, len(self.names)), MOST_LANGUAGES):
            names = self.names[first : first + MOST_LANGUAGES]
            counts = np.zeros((BUCKETS + 1, len(names)))
            if names:
                found = self.sums.where(F.col("number").between(first, first + len(names) - 1)).toArrow()
                counts[found["bucket"].to_numpy(), found["number"].to_numpy() - first] = found["n"].to_numpy()
            texts, counts = counts[BUCKETS], counts[:BUCKETS]
            logs = np.log((counts + ALPHA) / (counts.sum(0) + ALPHA * BUCKETS))
            yield names, np.vstack([logs, np.zeros((1, len(names))), np.log(texts / max(self.texts, 1))[None]]).astype(np.float32)


def train(rows: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Counts of every labelled row."""
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang")).where("lang is not null and text is not null")

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches(found, BATCH_BYTES):
            langs = batch.column(1).to_pylist()
            points, starts = symbols(batch.column(0).to_pylist())
            owners = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])[owners] * (BUCKETS + 1)
            add = sum(np.bincount(code + g, minlength=len(names) * (BUCKETS + 1)) for g in grams(points))
            for i, name in enumerate(names):
                own = totals.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                own[:BUCKETS] += add.reshape(len(names), -1)[i, :BUCKETS]
                own[BUCKETS] += langs.count(name)  # texts, for the prior
        for name, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], ["lang", "bucket", "n"])

    with batch_rows(rows.sparkSession):
        counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
        counts = written(counts, "langid-counts")
    held = counts.where(F.col("bucket") == BUCKETS).select("lang", "n")  # a row for each language
    numbers = held.withColumn("number", F.row_number().over(Window.orderBy(F.col("lang").cast("binary"))) - 1)
    found = numbers.orderBy("number").collect()
    return Model([r["lang"] for r in found], counts.join(numbers.select("lang", "number"), "lang").select("number", "bucket", "n"), sum(r["n"] for r in found))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (the posterior of that language) for each row."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.lit("und").alias("lang"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("rest"))
    held = f"key {kind}, text string, lang string, top double, rest double"
    blocks = -(-max(1, len(model.names)) // MOST_LANGUAGES)
    for number, block in enumerate(model.blocks(), 1):
        shared = spark.sparkContext.broadcast(block)

        def score(found: Iterator[pa.RecordBatch], shared=shared, last=number == blocks) -> Iterator[pa.RecordBatch]:
            names, table = shared.value
            for batch in batches(found, BATCH_BYTES):
                points, starts = symbols(batch.column(1).to_pylist())
                known = np.add.reduceat(points > 0, starts, dtype=np.int64) > 0
                before, top, rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                if names:
                    total = table[BUCKETS + 1].astype(np.float64)
                    total = total + sum(np.add.reduceat(table.take(g, axis=0), starts, axis=0, dtype=np.float64) for g in grams(points))
                    best = total.argmax(1)
                    most = total.max(1)
                    high = np.maximum(most, top)
                    rest = rest * np.exp(top - high) + np.exp(total - high[:, None]).sum(1)
                    langs, top = [names[b] if m > t else x for b, m, t, x in zip(best, most, top, before, strict=True)], high
                else:
                    known, langs, rest = known & False, before, np.ones(len(known))
                if last:
                    langs = [x if k else "und" for x, k in zip(langs, known, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.where(known, 1 / rest, 0.0))], ["key", "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(top), pa.array(rest)], ["key", "text", "lang", "top", "rest"])

        if number < blocks:
            with batch_rows(spark):
                out = written(out.mapInArrow(score, held), "langid-block")
        else:
            out = out.mapInArrow(score, f"key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

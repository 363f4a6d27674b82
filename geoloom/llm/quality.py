"""Quality classifier from positive and unlabelled texts (operator 7).

Trusted positives and unlabelled web text are described by word, line and character statistics and by
the shares of hashed words. A logistic model minimises the non-negative unbiased risk
    p * E+[loss(f)] + max(0, Eu[loss(-f)] - p * E+[loss(-f)]),
in whose negative part a step goes uphill while it is below 0, so that a flexible model can't drive
it there. The class prior p is estimated over thresholds t of a positive-against-unlabelled score: the
ratio of shares Pu(s > t) / P+(s > t) where its upper confidence bound is least, P+ of either half of
the positives by a model of the other half, Pu of all rows by one aggregation.

The weights are fitted on bounded samples, the SAMPLE keys of either kind with the least hashes (a
key that repeats gives one of its rows); the prior and the scores read every text in full.

Defined results: a null text counts as empty and is scored like any other; rows of null key are
scored, but not learned; without positives every score is 0; repeated rows get equal scores; other
columns are ignored, whatever their names; an empty table gives an empty table. A very long text is
a batch of its own.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import batch_rows, batches, documents, joined, remainder, texts, word_hashes

#: Rows of either kind that the model is fitted on.
SAMPLE = 8000
#: Buckets that words are hashed into: their shares of a text tell which words it has.
BUCKETS = 256
#: Thresholds at which shares are compared for the class prior.
LEVELS = 64
BATCH_BYTES = 1 << 20
THRESHOLD = 0.7
#: Classes of bytes whose shares of a text are features.
CLASSES = (b"#*$%&<>=+~^_\\{}[]@", b"|", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:'\"()-", b"abcdefghijklmnopqrstuvwxyz", b"\n", b" \t\r\x0b\x0c")


def features(parts: list[bytes]) -> np.ndarray:
    """A row of float32 for each text, by whole texts."""
    n = len(parts)
    buffer, starts, lengths = joined([x + b"\n" for x in parts], 8)
    data = np.frombuffer(buffer, np.uint8)[: len(buffer) - 8]
    kinds = np.zeros((256, len(CLASSES)), np.float32)
    for i, members in enumerate(CLASSES):
        kinds[list(members), i] = 1
    owners = np.repeat(np.arange(n, dtype=np.int64), lengths)
    size = np.maximum(lengths - 1, 1)[:, None]
    each = np.bincount(owners * 256 + data, minlength=n * 256).reshape(n, 256)
    shares = (each @ kinds) / size
    words = np.zeros((n, 5), np.float32)
    for i, x in enumerate(parts):
        w = x.lower().split()
        if w:
            lines = x.split(b"\n")
            again = sum(map(operator.eq, w, w[1:]))
            words[i] = (np.log1p(len(w)) / 10, again / len(w), len(set(w)) / len(w), min(len(x) / len(w), 40) / 10, 1 - len(set(lines)) / len(lines))
    hashes, sizes = word_hashes(parts)
    place = np.repeat(np.arange(n), sizes) * BUCKETS + (hashes.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)
    which = np.bincount(place, minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(sizes, 1)[:, None]
    return np.hstack([shares, np.sqrt(shares), words, words[:, 1:2] ** 0.5, np.sqrt(which)]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def descend(gradient, width: int, rounds: int, rate: float = 0.05) -> np.ndarray:
    """Adam from 0, all rows a step."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def halves(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 200) -> list[np.ndarray]:
    """For each half of the rows a model of positives against unlabelled. Rows end in a 1."""
    out = []
    for half in (0, 1):
        own_p, own_u = positive[half::2], unlabelled[half::2]

        def gradient(w: np.ndarray, own_p: np.ndarray = own_p, own_u: np.ndarray = own_u) -> np.ndarray:
            return (-sigmoid(-(own_p @ w)) @ own_p / max(1, len(own_p)) + sigmoid(own_u @ w) @ own_u / max(1, len(own_u))) / 2 + 1e-2 * w

        out.append(descend(gradient, positive.shape[1], rounds))
    return out


def thresholds(positive: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """[2, LEVELS]: scores that half or more of the positives pass, of each half by the model of the other."""
    return np.array([np.quantile(positive[1 - half :: 2] @ w if len(positive) > 1 else positive @ w, np.linspace(0, 0.5, LEVELS)) for half, w in enumerate(models)])


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in deviations from the mean, those of hashed words together as one, and a 1."""
    z = ((x - mean) / scale).clip(-8, 8)
    z[:, -BUCKETS:] /= np.sqrt(BUCKETS)
    return np.hstack([z, np.ones((len(x), 1))]).astype(np.float64)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | Callable[[dict], float], rounds: int = 400, decay: float = 1e-2) -> dict:
    """The model: standardisation, weights, and the class prior that was used; prior may be found from models of the halves."""
    model = {"mean": unlabelled.mean(0), "scale": unlabelled.std(0) + 1e-3}
    p, u = (standard(x, model["mean"], model["scale"]) for x in (positive, unlabelled))
    if callable(prior):
        models = halves(p, u)
        prior = prior(model | {"halves": models, "levels": thresholds(p, models), "positives": len(p)})

    def gradient(w: np.ndarray) -> np.ndarray:
        fp, fu = p @ w, u @ w
        loss = lambda f: np.logaddexp(0, -f)
        up = -prior * (sigmoid(-fp) @ p) / len(p)
        down = sigmoid(fu) @ u / len(u) - prior * (sigmoid(fp) @ p) / len(p)
        if loss(-fu).mean() - prior * loss(-fp).mean() < 0:
            return -down + decay * w
        return up + down + decay * w

    return model | {"weights": descend(gradient, p.shape[1], rounds), "prior": prior}


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    return np.zeros(len(x)) if model is None else sigmoid(standard(x, model["mean"], model["scale"]) @ model["weights"])


def prior_of(docs: DataFrame, text: str, model: dict) -> float:
    """The share of positives in all docs, by how many of them pass the thresholds of held-out positives."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, over, rows = shared.value, np.zeros((2, LEVELS), np.int64), 0
        for batch in batches(found, BATCH_BYTES):
            x = standard(features(texts(batch)), m["mean"], m["scale"])
            rows += len(x)
            for half, (w, levels) in enumerate(zip(m["halves"], m["levels"], strict=True)):
                over[half] += len(x) - np.searchsorted(np.sort(x @ w), levels)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * LEVELS + 1)), pa.array(np.append(over.ravel(), rows))], ["place", "n"])

    with batch_rows(docs.sparkSession):
        sums = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    n = dict(sums)
    return best_ratio(np.array([n.get(i, 0) for i in range(2 * LEVELS)]).reshape(2, LEVELS), n.get(2 * LEVELS, 0), model["positives"])


def best_ratio(over: np.ndarray, rows: int, positives: int) -> float:
    """The ratio of shares above the threshold at which its upper confidence bound is least (best bin estimation).

    over: [2, LEVELS] of all rows; a bound by the sizes of both samples keeps small shares' noise from being the least.
    """
    share = 1 - np.linspace(0, 0.5, LEVELS)
    ratio = over / max(1, rows) / share
    bound = ratio + (np.sqrt(np.log(40) / (2 * max(1, rows))) + np.sqrt(np.log(40) / max(1, positives))) / share
    return float(np.clip(ratio.ravel()[bound.argmin()], 0.01, 0.99))


def train(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict | None:
    """Fit on at most `sample` of the keys in positives and as many rows of docs, of whatever quality; the class prior is of all docs."""
    spark = docs.sparkSession
    k, kind = F.col(f"`{key}`").alias("key"), docs.schema[key].dataType.simpleString()
    positives = positives.select(F.col(f"`{key}`").cast(kind).alias("key"))
    least = lambda df, label: df.where("key is not null").distinct().withColumn("h", F.xxhash64("key", F.lit(7))).orderBy("h", "key").limit(sample).select("key", F.lit(label).alias("kind"))
    chosen = least(positives, 1).unionByName(least(docs.select(k), 0))  # at most 2 * sample keys
    rows = docs.select(k, F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "key")

    def describe(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, BATCH_BYTES):
            x = features(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "kind", "x"])

    found = rows.select("key", "text", "kind").mapInArrow(describe, f"key {kind}, kind int, x binary")
    with batch_rows(spark):
        got = found.groupBy("kind", "key").agg(F.min("x").alias("x")).orderBy("kind", "key").collect()  # a row for a key
    matrix = lambda label: [np.frombuffer(r.x, np.float32) for r in got if r.kind == label]
    p, u = matrix(1), matrix(0)
    return fit(np.array(p, np.float64), np.array(u, np.float64), lambda model: prior_of(docs, text, model)) if p and u else None


def score(df: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's columns and score double; a column of that name is replaced."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    df = df.drop("score")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["score double"])
    at = df.columns.index(text)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, BATCH_BYTES, text):
            s = scores(shared.value, features([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    return df.mapInArrow(run, schema)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of training rows that are marked good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where((F.col("quality") == 1) & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out), trusted(spark, sf_dir))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

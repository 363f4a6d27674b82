"""Quality rules with robust multivariate outliers, in DataFrame operations only (operator 4).

Counts of each text give a vector of four transformed statistics: word length, symbols, repeated
lines and repeated five-word windows, each shrunk towards a typical value for short texts. For each
(language, source) the minimum-covariance-determinant estimate takes the COVER share of rows with
the least determinant of their covariance: from three starts, concentration steps keep the rows of
least Mahalanobis distance and estimate anew until the determinant falls no more; the least one is
taken. A row whose squared distance exceeds the chi-square quantile 1 - TAIL is rejected.

One step is one aggregation: rows are added up by (group, bin of squared distance), combined before
the shuffle, and running sums over the bins give the estimate of the nearest rows; no task holds a
group. A group of fewer than MIN_ROWS rows is judged by the estimate of its language, or of all.

Defined results: a null or empty text has no words, so base_failed; null language or source is a
group of its own; an estimate of fewer than MIN_ROWS rows rejects nothing; equal texts of one group get
equal verdicts; an empty table gives an empty table; other columns are ignored, whatever their names.
A very long text is split into words and windows in its task, some hundred bytes for each word.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import bounded, documents, dropped, written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_WORDS, MOST_REPEATED = 10, 20  # words; per cent of words
COVER = 0.75
#: Steps at most, and the fall of a log determinant below which they end.
STEPS, CONVERGED = 15, 1e-3
#: Share of rows of a normal sample that are rejected.
TAIL = 1e-4
MIN_ROWS = 50
#: Bins of squared distance in each e-fold.
BINS = 32
#: Groups up to which their estimates are broadcast; above, the join shuffles.
BROADCAST_ROWS = 20_000
#: Least standard deviation of each statistic: what differs by less than some of it is no reason to reject, however alike a group's rows are.
FLOORS = (0.3, 0.08, 0.15, 0.12)
NAMES = ("word_length", "symbols", "lines", "repeats")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where lambdas in body use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words of an array covered by WINDOW-word windows that occur in it twice or more.

    Windows are compared by XXH64; two different ones of a text with 10^5 words agree with a
    probability below 10^-9.
    """
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            same = lambda row, j: F.get(rows, j)["h"].eqNullSafe(row["h"])
            found = F.transform(F.filter(rows, lambda row, j: same(row, j - 1) | same(row, j + 1)), lambda row: row["i"])
            steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return let(F.sort_array(found), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, twice))

    return F.when(F.size(words) < WINDOW, 0).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), at), covered))


def counts(text: Column) -> Column:
    """Struct of the counts of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(F.array_remove(F.split(text, SPACE), ""), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeat")))
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("symbols"))


def statistics() -> list[Column]:
    n = F.col("n_words")
    return [
        (F.col("word_chars") + 50 * 5.0) / (n + 50),
        F.sqrt(F.col("n_symbols") / (n + 50)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        F.sqrt(F.col("n_repeat_words") / (n + 50)),
    ]


def chi2_tail(x: float, half: int) -> float:
    """P(X > x) for chi-square with 2 * half degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def chi2_quantile(tail: float, half: int) -> float:
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, half) > tail else (low, mid)
    return low


def factor(rows: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """rows with the lower Cholesky factor l00, l10, l11, ... of cov, column by column."""
    p = len(NAMES)
    for j in range(p):
        root = cov[j, j] - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        rows = rows.withColumn(f"l{j}{j}", F.sqrt(F.greatest(root, F.lit(1e-12))))
        rows = rows.withColumns({f"l{i}{j}": (cov[j, i] - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, p)})
    return rows


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from mean m0.. under the factor l: forward substitution."""
    z: list[Column] = []
    for i in range(len(NAMES)):
        z.append((F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((x * x for x in z), F.lit(0.0))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if bounded(df, BROADCAST_ROWS) else df


def grouped(rows: DataFrame, by: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """rows with level, g0, g1 (their own group, or the pool they fall to), and the rows that shape each estimate.

    Sizes are of rows that pass the base rules. A pool holds all such rows of its language, or all.
    """
    rows = rows.withColumns({"o0": F.col(f"`{by[0]}`").cast("string"), "o1": F.col(f"`{by[1]}`").cast("string")}).drop(*by)
    passing = rows.where(~F.col("base_failed"))
    sizes = passing.groupBy("o0", "o1").agg(F.count(F.lit(1)).alias("n"))
    pool = F.sum("n").over(Window.partitionBy("o0"))
    sizes = sizes.select("o0", "o1", "n", F.when(F.col("n") >= MIN_ROWS, 0).when(pool >= MIN_ROWS, 1).otherwise(2).alias("level"))
    little = written(sizes.where("level > 0").select(F.col("o0").alias("k0"), F.col("o1").alias("k1"), "level"), "rules-pools")

    def at(frame: DataFrame, level: Column) -> DataFrame:
        return frame.withColumns({"level": level, "g0": F.when(level < 2, F.col("o0")), "g1": F.when(level < 1, F.col("o1"))})

    out = rows.join(small(little), rows.o0.eqNullSafe(F.col("k0")) & rows.o1.eqNullSafe(F.col("k1")), "left").drop("k0", "k1")
    out = at(out, F.coalesce("level", F.lit(0)))
    shaping = out.where((F.col("level") == 0) & ~F.col("base_failed"))
    pools = little.where("level = 1").select("k0").distinct()
    shaping = shaping.unionByName(at(passing.join(small(pools), passing.o0.eqNullSafe(F.col("k0"))).drop("k0"), F.lit(1)))
    if little.where("level = 2").limit(1).count():
        shaping = shaping.unionByName(at(passing, F.lit(2)))
    return out, shaping


GROUP = ["level", "g0", "g1"]


def with_estimates(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    other = estimates.withColumnsRenamed({c: f"k_{c}" for c in GROUP})
    on = [rows[c].eqNullSafe(F.col(f"k_{c}")) for c in GROUP]
    return rows.join(small(other), on[0] & on[1] & on[2]).drop(*[f"k_{c}" for c in GROUP])


def covariances(sums: Callable[[str], Column], n: Column, widen: float) -> dict[tuple[int, int], Column]:
    """Covariance from sums s0.. and s00..; a statistic's variance is at least FLOORS ** 2, its covariances shrink alike."""
    p = range(len(NAMES))
    cov = {(i, j): widen * (sums(f"s{i}{j}") / n - sums(f"s{i}") * sums(f"s{j}") / (n * n)) for i in p for j in p if j >= i}
    return {(i, j): F.greatest(v, F.lit(FLOORS[i] ** 2)) if i == j else v for (i, j), v in cov.items()}


def estimate(rows: DataFrame, cover: float = COVER, steps: int = STEPS) -> DataFrame:
    """A row for each group of rows (GROUP, x0..): its mean m0.. and factor l00.. of the covariance of least determinant.

    Three starts are concentrated side by side: medians and quartiles, the mean and covariance of the
    rows within a spread of all medians, and those of all rows. A step keeps the nearest `cover` of
    rows and estimates anew; steps go on until no start's log determinant falls by CONVERGED or more.
    """
    p = range(len(NAMES))
    pairs = [(i, j) for i in p for j in p if j >= i]
    found = rows.groupBy(*GROUP).agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in p])
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i]))
    middle = written(found.select(*GROUP, *[F.col(f"q{i}")[1].alias(f"m{i}") for i in p], *[(spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in p for j in range(i + 1)]), "rules-middle")
    columns = [*GROUP, "start", *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in range(i + 1)], "logdet"]

    def logdet(frame: DataFrame) -> DataFrame:
        return frame.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in p), F.lit(0.0)))

    def shifted(frame: DataFrame) -> DataFrame:
        return frame.withColumns({f"y{i}": F.col(f"x{i}") - F.col(f"m{i}") for i in p})

    def moved(sums: DataFrame, widen: float) -> DataFrame:
        """Estimates of sums (GROUP, start, n, s0.., s00.. of rows shifted by old0..)."""
        new = factor(sums, covariances(F.col, F.col("n"), widen))
        return logdet(new.withColumns({f"m{i}": F.col(f"old{i}") + F.col(f"s{i}") / F.col("n") for i in p})).select(columns)

    added = [F.count(F.lit(1)).alias("n"), *[F.sum(f"y{i}").alias(f"s{i}") for i in p], *[F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"s{i}{j}") for i, j in pairs]]
    olds = [F.max(f"m{i}").alias(f"old{i}") for i in p]  # the same on all rows of a group and start
    near = shifted(with_estimates(rows, middle))
    core = F.forall(F.array(*[F.abs(F.col(f"y{i}")) <= F.col(f"l{i}{i}") for i in p]), lambda x: x)
    both = near.withColumn("start", F.explode(F.when(core, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    starts = moved(both.groupBy(*GROUP, "start").agg(*added, *olds), 1.0)
    found = written(logdet(middle.withColumn("start", F.lit(0))).select(columns).unionByName(starts), "rules-estimate")
    # The nearest `cover` of a normal sample has a covariance that is too small by this factor.
    half = len(NAMES) // 2
    widen = cover / (1 - chi2_tail(chi2_quantile(1 - cover, half), half + 1))
    names = ["n", *[f"s{i}" for i in p], *[f"s{i}{j}" for i, j in pairs]]
    key = [*GROUP, "start"]
    for _ in range(steps):
        near = shifted(with_estimates(rows, found)).withColumn("bin", F.floor(F.log(distance() + 1e-4) * BINS).cast("int"))
        binned = near.groupBy(*key, "bin").agg(*added, *olds)
        whole, upto = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        run = binned.select(*key, "bin", *[f"old{i}" for i in p], F.sum("n").over(whole).alias("all"), *[F.sum(c).over(upto).alias(c) for c in names])
        first = run.where(F.col("n") >= cover * F.col("all")).groupBy(*key).agg(F.min_by(F.struct(*names, *[f"old{i}" for i in p]), "bin").alias("t")).select(*key, "t.*")
        new = written(moved(first, widen), "rules-estimate")
        before = found.select(*[F.col(c).alias(f"k_{c}") for c in key], F.col("logdet").alias("old"))
        fell = new.join(small(before), [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]).agg(F.max(F.col("old") - F.col("logdet"))).first()[0]
        dropped(found)
        found = new
        if fell is None or fell < CONVERGED:
            break
    best = found.groupBy(*GROUP).agg(F.min_by(F.struct(*columns[len(key):]), F.struct("logdet", "start")).alias("best"))
    return written(best.select(*GROUP, "best.*").drop("logdet"), "rules-least")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source"), tail: float = TAIL) -> DataFrame:
    """key, the counts, base_failed, distance (squared) and kept for each row of df."""
    rows = df.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(by)], counts(F.col(f"`{text}`")).alias("c"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    rows = rows.select("key", "by0", "by1", long("c.words.n", "n_words"), long("c.words.chars", "word_chars"), long("c.symbols", "n_symbols"), long("c.lines.dup", "n_dup_lines"), long("c.words.repeat", "n_repeat_words"), long("c.lines.n", "n_lines"))
    rows = written(rows, "rules-counts")
    rows = rows.withColumns({f"x{i}": x for i, x in enumerate(statistics())})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", failed), "rules-statistics")
    rows, shaping = grouped(rows, ("by0", "by1"))
    # Estimates are of rows that pass the base rules, so that whole pages of junk don't shape them.
    found = estimate(shaping)
    enough = written(shaping.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows")), "rules-enough")
    found = written(with_estimates(enough, found), "rules-final")
    other = found.withColumnsRenamed({c: f"k_{c}" for c in GROUP})
    on = [rows[c].eqNullSafe(F.col(f"k_{c}")) for c in GROUP]
    judged = rows.join(small(other), on[0] & on[1] & on[2], "left").withColumn("distance", distance())
    outlier = F.coalesce((F.col("rows") >= MIN_ROWS) & (F.col("distance") > chi2_quantile(tail, len(NAMES) // 2)), F.lit(False))
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~outlier).alias("kept"), "distance")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))

"""Image catalogues and map answers: scenes, stacks, composites, tag queries, attributes of features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
# Scene classes without a view of the ground (shadow, clouds, cirrus), and the last one there is.
CLOUDED, LAST_CLASS = (3, 8, 9, 10), 11
#: Values of an attribute up to which it is offered as a label, and examples that are shown.
MOST_VALUES, EXAMPLES = 255, 5


def best_scene(scenes: DataFrame, by: Sequence[str], most_cloud: float, covers: Column | None = None) -> DataFrame:
    """by, id, candidates: of the scenes (id, taken, cloud) that cover their area with a known cloud share of at most
    most_cloud the least cloudy, then the earliest, then the first id."""
    found = scenes.where((c("cloud") <= most_cloud) & (covers if covers is not None else F.lit(True)))
    return found.groupBy(*by).agg(F.min_by("id", F.struct("cloud", "taken", "id")).alias("id"), F.count(F.lit(1)).alias("candidates"))


def covers(outer: Column, inner: Column) -> Column:
    """Whether a box (struct west, south, east, north) holds another, its sides included."""
    return (outer["west"] <= inner["west"]) & (outer["south"] <= inner["south"]) & (outer["east"] >= inner["east"]) & (outer["north"] >= inner["north"])


def clear(scene_class: Column) -> Column:
    """Whether a pixel's scene class shows the ground."""
    return ~scene_class.isin(*CLOUDED) & (scene_class <= LAST_CLASS)


def cloud_masked(stack: DataFrame, scene_class: str, bands: Sequence[str]) -> DataFrame:
    """stack with valid, and bands null where it isn't."""
    seen = clear(c(scene_class))
    return stack.withColumn("valid", seen).withColumns({b: F.when(seen, c(b)) for b in bands})


def band_gaps(values: DataFrame, by: Sequence[str], band: str, there: Column) -> DataFrame:
    """by, band: bands without any data where another band has some."""
    found = values.groupBy(*by, band).agg(F.bool_or(there).alias("__there"))
    some = F.max(c("__there").cast("int")).over(Window.partitionBy(*by)) == 1
    return found.withColumn("__some", some).where(~c("__there") & c("__some")).select(*by, band)


def composite(images: DataFrame, by: Sequence[str], value: str, order: Sequence[str], most_cloud: Column | None = None) -> DataFrame:
    """by, median, mean, low, high, top (the last in order) of the values of the images that most_cloud lets in."""
    rows = images if most_cloud is None else images.where(most_cloud)
    return rows.groupBy(*by).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, F.struct(*order)).alias("top"))


def tag_selector(wanted: Mapping[str, str | Sequence[str]]) -> str:
    """The filters of a map query: a key alone for '*', a value, or one of several."""
    quote = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    special = lambda x: "".join("\\" + ch if ch in "\\^$.|?*+()[]{}" else ch for ch in x)
    out = []
    for key, value in wanted.items():
        if value == "*":
            out.append(f"[{quote(key)}]")
        elif isinstance(value, str):
            out.append(f"[{quote(key)}={quote(value)}]")
        else:
            out.append(f"[{quote(key)}~{quote('^(' + '|'.join(map(special, value)) + ')$')}]")
    return "".join(out)


def tag_query(selector: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """The statement that asks for everything with a selector's tags in a box."""
    return F.concat(F.lit("nwr"), selector, F.lit("("), F.concat_ws(",", *[v.cast("string") for v in (south, west, north, east)]), F.lit(");"))


def ordered_features(elements: DataFrame, class_name: str, kind: str, key: str) -> DataFrame:
    """elements with place, their order within a class: the later lies on top."""
    return elements.withColumn("place", F.row_number().over(Window.partitionBy(class_name).orderBy(kind, key)).cast("bigint"))


def attributes(features: DataFrame, properties: str = "properties") -> DataFrame:
    """field, value, n of all attributes of features (a map of texts), null values left out."""
    return features.select(F.explode(properties).alias("field", "value")).where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def label_fields(table: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, value, n, rank: the most frequent values of each column that has few enough to be a label.

    Columns that clearly have more are told by one pass of sketches, so that long texts are never grouped.
    """
    sketch = table.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in fields]).first()
    likely = [f for f in fields if sketch[f] <= 2 * MOST_VALUES]
    if not likely:
        return table.sparkSession.createDataFrame([], "field string, value string, n long, rank long")
    long = table.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c(f).cast("string").alias("value")) for f in likely])))
    return top_values(long.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))


def top_values(counts: DataFrame) -> DataFrame:
    """Of counts (field, value, n) the EXAMPLES most frequent values of each field of at most MOST_VALUES, with rank."""
    kinds = counts.groupBy("field").agg(F.count(F.lit(1)).alias("kinds")).where(c("kinds") <= MOST_VALUES)
    rank = F.row_number().over(Window.partitionBy("field").orderBy(c("n").desc(), "value")).cast("bigint")
    return counts.join(kinds, "field", "left_semi").withColumn("rank", rank).where(c("rank") <= EXAMPLES)


def closest(names: DataFrame, name: str, known: Sequence[str]) -> DataFrame:
    """name, known: of a list of names the one of least edit distance, then the first in order; no join."""
    if not known:
        raise ValueError("there are no names to compare with")
    each = F.array(*[F.struct(F.levenshtein(name, F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in sorted(known)])
    return names.select(name, F.array_min(each)["k"].alias("known"))

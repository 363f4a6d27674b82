"""Labels, headers, URLs and paths as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
MAX_CLASS = 255
# Fixed values of HTTP freshness, in seconds.
DEFAULT_TTL = 7 * 24 * 3600.0
MAX_TTL = 365 * 24 * 3600.0


def normalised_label(value: Column) -> Column:
    """A label's stable text: trimmed, blank as null, and whole numbers written with a point without it."""
    text = F.trim(value.cast("string"))
    whole = F.rlike(text, F.lit(NUMBER)) & F.contains(text, F.lit("."))
    number = F.when(whole, F.try_to_number(F.regexp_extract(text, r"^([+-]?\d*)\.0*$", 1), F.lit("S99999999999999")).cast("bigint"))
    return F.when(text == "", None).otherwise(F.coalesce(number.cast("string"), text))


def label_order(label: Column) -> Column:
    """Struct that sorts numbers by value before all other labels by text."""
    number = F.when(F.rlike(label, F.lit(NUMBER)), label.try_cast("double"))
    return F.struct(number.isNull().cast("int").alias("kind"), F.coalesce(number, F.lit(0.0)).alias("number"), label.alias("label"))


def class_ids(labels: DataFrame, label: str, classes: Mapping[str, int] | None = None) -> DataFrame:
    """label, class_id for each distinct label that isn't null (0: not mapped).

    Given classes win; labels that are all integers of 1..255 are their own ids; others are numbered
    from 1 in label order. More than 255 distinct labels are an error.
    """
    present = labels.select(c(label).alias("label")).where("label is not null").distinct()
    if classes is not None:
        pairs = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(int(v)))]) if classes else None
        given = F.coalesce(F.try_element_at(pairs, c("label")), F.lit(0)) if classes else F.lit(0)
        return present.select("label", given.cast("bigint").alias("class_id"))
    whole = F.when(F.rlike("label", F.lit(r"^\d{1,9}$")), c("label").cast("bigint"))
    ranked = present.withColumn("class_id", F.row_number().over(Window.orderBy(label_order(c("label")))))
    few = F.when(c("n") > MAX_CLASS, F.raise_error(F.lit("a mask has at most 255 classes"))).otherwise(c("class_id"))
    own = present.agg(F.coalesce(F.bool_and(F.coalesce(whole.between(1, MAX_CLASS), F.lit(False))), F.lit(False)).alias("own"), F.count(F.lit(1)).alias("n"))
    return ranked.crossJoin(F.broadcast(own)).select("label", F.when(c("own"), whole).otherwise(few).cast("bigint").alias("class_id"))


def freshness(cache_control: Column, expires: Column, date: Column, age: Column, now: Column) -> Column:
    """Seconds that a response stays fresh, null if it must not be kept. expires, date, now: epoch seconds."""
    control = F.lower(F.coalesce(cache_control, F.lit("")))
    never = F.rlike(control, F.lit(r"(^|,)\s*no-(store|cache)\s*(=|,|$)"))
    given = F.rlike(control, F.lit(r"(^|,)\s*max-age\s*(=|,|$)"))
    seconds = F.regexp_extract(control, r"(?:^|,)\s*max-age\s*=\s*\"?\s*([+-]?\d{1,15})\s*\"?\s*(?:,|$)", 1).try_cast("double")
    elapsed = F.greatest(F.lit(0.0), F.coalesce(F.nullif(age.try_cast("double"), F.lit(float("nan"))), F.lit(0.0)))
    lifetime = F.when(given, F.coalesce(seconds, F.lit(0.0))).when(expires.isNotNull(), expires - F.coalesce(date, now))
    left = F.least(lifetime - elapsed, F.lit(MAX_TTL))
    return F.when(never, None).when(lifetime.isNull(), F.lit(DEFAULT_TTL)).when(left > 0, left)


def image_kind(data: Column) -> Column:
    """png, jpeg, gif, webp by the first bytes, else null."""
    starts = lambda text, at=1: F.substring(data, at, len(text)) == F.lit(text)
    return F.when(starts(b"\x89PNG\r\n\x1a\n"), "png").when(starts(b"\xff\xd8\xff"), "jpeg").when(starts(b"GIF8"), "gif").when(starts(b"RIFF") & starts(b"WEBP", 9), "webp")


def matches_tags(tags: Column, wanted: Mapping[str, str | Sequence[str]]) -> Column:
    """Whether a map has every wanted key with the value, one of the values, or any ('*')."""
    out = F.lit(True)
    for key, value in wanted.items():
        have = F.try_element_at(tags, F.lit(key))
        test = have.isNotNull() if value == "*" else have.isin(*([value] if isinstance(value, str) else value))
        out = out & F.coalesce(test, F.lit(False))
    return out


def tag_class(tags: Column, classes: Sequence[tuple[str, Mapping]]) -> Column:
    """The first class, in order, whose tags match."""
    return F.coalesce(*[F.when(matches_tags(tags, wanted), F.lit(name)) for name, wanted in classes])


def is_area(n_coords: Column, closed: Column, tags: Column, linear: Sequence[str] = ("highway", "barrier", "railway", "waterway")) -> Column:
    """Whether a way is a polygon: closed, and not a line by its tags."""
    area = F.try_element_at(tags, F.lit("area"))
    has_line = F.exists(F.array(*[F.lit(k) for k in linear]), lambda k: F.map_contains_key(tags, k))
    line = F.coalesce(area == "no", F.lit(False)) | (has_line & ~F.coalesce(area == "yes", F.lit(False)))
    return (n_coords >= 4) & closed & ~line


def tile_url(template: Column, x: Column, y: Column, z: Column) -> Column:
    for mark, value in (("{x}", x), ("{y}", y), ("{z}", z)):
        template = F.replace(template, F.lit(mark), value.cast("string"))
    return template


def redacted_url(url: Column) -> Column:
    """Scheme and host alone of a URL; other text as it is."""
    host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 2)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.when(host == "", url).otherwise(F.concat(scheme, F.lit("://"), F.lower(host), F.lit("/...")))


def redacted_query(url: Column) -> Column:
    """A URL without user info, the values of its query hidden."""
    clean = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#@]*@", "$1")
    return F.regexp_replace(clean, r"(?<=[?&])([^=&#]+)=[^&#]*", "$1=***")


def redacted_text(text: Column) -> Column:
    """Text whose URLs show scheme and host alone."""
    return F.regexp_replace(text, r"(https?://)(?:[^/\s\"'<>@]*@)?([^/\s\"'<>)\]?#]+)[^\s\"'<>)\]]*", "$1$2/...")


def dataset_path(path: Column) -> Column:
    """Whether a path stays inside its folder: relative, /-separated, no empty, . or .. part."""
    odd = F.rlike(path, F.lit(r"[\\:\x00\n]")) | (path == "") | F.startswith(path, F.lit("/"))
    return ~odd & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def internal_ip(ip: Column) -> Column:
    """Whether an IPv4 address is on this machine, a private network, or not one host."""
    octet = F.transform(F.split(ip, r"\."), lambda x: x.cast("bigint"))
    value = F.aggregate(octet, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
    nets = [("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("0.0.0.0", 32), ("255.255.255.255", 32), ("224.0.0.0", 4), ("100.64.0.0", 10)]
    out = F.lit(False)
    for net, bits in nets:
        low = sum(int(x) << s for x, s in zip(net.split("."), (24, 16, 8, 0), strict=True))
        out = out | value.between(low, low + (1 << (32 - bits)) - 1)
    return out


def invalid_vertices(ring: Column) -> Column:
    """Whether an array of x, y has one that is no finite longitude and latitude."""
    bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    return F.exists(ring, lambda p: bad(p["x"]) | bad(p["y"]) | (F.abs(p["y"]) > 90))


def jumps(ring: Column) -> Column:
    """Whether an edge spans over 180 and under 360 degrees: its short way crosses 0."""
    steps = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.abs(F.get(ring, i)["x"] - F.get(ring, i - 1)["x"]))
    return F.when(F.size(ring) < 2, False).otherwise(F.exists(steps, lambda d: (d > 180) & (d < 360)))


def wrapped_ring(ring: Column) -> Column:
    """A ring of 0..360 longitudes in -180..180 where it lies wholly east of 180 degrees or crosses 0; null where it crosses 180."""
    xs = F.transform(ring, lambda p: p["x"])
    low, high = F.array_min(xs), F.array_max(xs)
    moved = F.transform(ring, lambda p: F.struct((p["x"] - F.when(p["x"] > 180, 360.0).otherwise(0.0)).alias("x"), p["y"].alias("y")))
    shifted = F.transform(ring, lambda p: F.struct((p["x"] - 360.0).alias("x"), p["y"].alias("y")))
    return F.when(high <= 180, ring).when(low >= 180, shifted).when(jumps(ring), moved)


def tenths(value: Column) -> Column:
    """A number of 0 or more with one decimal, rounded by its exact binary value, a tie to the even digit.

    format_string rounds the shortest decimal that stands for it, half up: 21.25 and 9.35, which is less than that, go up.
    """
    whole = F.floor(value)
    part = ((value - whole) * F.lit(2.0**52)).cast("bigint") * 20 + F.lit(1 << 52)  # exact: a double of 1 or more is a multiple of 2^-52
    up = F.shiftright(part, 53)
    n = whole * 10 + up
    n = n - F.when((F.shiftleft(up, 53) == part) & (n % 2 == 1), 1).otherwise(0)
    return F.when(value < F.lit(2.0**52), F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))).otherwise(F.format_string("%.1f", value))


def human_bytes(size: Column) -> Column:
    out = F.concat(tenths(size / 1e12), F.lit(" TB"))
    for power, unit in ((9, "GB"), (6, "MB"), (3, "KB")):
        out = F.when(size < 10.0 ** (power + 3), F.concat(tenths(size / 10.0**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1000, F.concat(size.cast("bigint").cast("string"), F.lit(" B"))).otherwise(out)


def size_category(n: Column) -> Column:
    return F.when(n < 1000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").when(n < 1_000_000, "100K<n<1M").otherwise("n>1M")


def yolo_number(value: Column) -> Column:
    """0..1 with ten decimals, no zeros behind."""
    text = F.format_string("%.10f", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def rfc_interval(value: Column) -> Column:
    """A date or interval as the closed interval of whole days."""
    day = F.lit(r"^\d{4}-\d{2}-\d{2}$")
    parts = F.split(value, "/")
    one = F.size(parts) == 1
    start, end = F.get(parts, 0), F.when(one, F.get(parts, 0)).otherwise(F.get(parts, 1))
    first = F.when(F.rlike(start, day), F.concat(start, F.lit("T00:00:00Z"))).otherwise(start)
    last = F.when(F.rlike(end, day), F.concat(end, F.lit("T23:59:59Z"))).otherwise(end)
    return F.when(one & ~F.rlike(value, day), value).otherwise(F.concat(first, F.lit("/"), last))

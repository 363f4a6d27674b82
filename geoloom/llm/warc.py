"""WARC archives: written with revisit records, read by boundary-chain verification (operator 9).

Writing: one record for each row. Of records with equal payloads the one with the largest id is the
response, the others are revisits that refer to it and carry its digest and length.
Reading: files are split where Spark splits them, at the magic that begins a record. A task looks for
every place of its split where a record could begin and computes from its header where the next
would (candidate -> successor offsets). Pointer jumping in the split's arrays leads each candidate to
the first place beyond the split; the few candidates that another split leads to, and the file's
first byte, are a table on which pointer jumping by joins doubles the known chain in each round.
Candidates that the chain doesn't reach, such as the magic inside a payload, are dropped. A second
scan reads the records on the chain; one whose parts lie in several splits is put together by its
offset. A chain that doesn't end at the file's last byte is an error.

Records of all types are read, also of archives of other makers, plain or of gzip members. Payloads
of HTTP responses are what follows the HTTP header.

Defined results: a null payload is empty, and empty payloads count as equal; repeated rows (equal id
and payload) with the largest id are all responses; a null id counts as smaller than any other and
comes back as null; an empty table gives an archive without records; other columns are ignored,
whatever their names. A header is at most HEADER bytes long. A record is held by one task, so a very
long page needs some times its size there.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import bounded, packed, release, scratch_path, unpacked, written

#: What begins a record of version 1.0 or 1.1, and ends a header and a record.
MAGIC, BLANK = b"WARC/1.", b"\r\n\r\n"
END = BLANK.decode()
HEADER = 1 << 16
#: Rows of the table of repeated payloads up to which it is broadcast; above, the join shuffles.
BROADCAST_ROWS = 100_000
READ = ("record_id long", "payload_bytes long", "payload_digest string", "record_type string", "refers_to long", "verified boolean", "id string", "uri string")
_NAMES = [x.split()[0] for x in READ]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
SPLITS = "file string, block long, total long, pos array<long>, exit array<long>, last array<long>, open array<long>, open_text binary, lead binary"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in RFC 4648 base 32: 160 bits are 32 digits, four for each five hex digits."""
    digest = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(df: DataFrame, path: str, record_id: str = "page_id", payload: str = "html", uri: str = "url") -> None:
    """Write df as WARC files under path, one for each task; readers split them."""
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = df.select(F.col(f"`{record_id}`").cast("long").alias("id"), body.alias("body"), (F.col(f"`{uri}`") if uri in df.columns else F.lit(None)).cast("string").alias("uri"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("body").cast("binary")), "length": F.octet_length("body").cast("long")})
    same = rows.groupBy("digest").agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = written(same.where("n > 1").select("digest", "first_id"), "warc-digests")
    if bounded(repeated, BROADCAST_ROWS):
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, "digest", "left")
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("uri", r"[\x00-\x20\x7F]+", "%20")), F.lit("")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first_id"))), line("X-Payload-Length", F.col("length").cast("string")))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("body")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def header(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block.split(b"\r\n")[1:])}


def length_of(head: bytes) -> int:
    """Bytes of the block after a header, -1 if that isn't one."""
    length = header(head).get(b"content-length", b"") if head[7:10] in (b"0\r\n", b"1\r\n") else b""
    return int(length) if length.isdigit() else -1


def parsed(raw: bytes) -> tuple:
    """READ of a record from its magic to its block's end."""
    stop = raw.find(BLANK)
    fields, block = header(raw[:stop]), raw[stop + 4 :]
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    own = lambda x: int(x) if (x := (x or "").removeprefix("<urn:record:").removesuffix(">")).lstrip("-").isdigit() else None
    kind, noted = text(b"warc-type"), (text(b"warc-payload-digest") or "").partition(":")
    if kind == "revisit":
        size = text(b"x-payload-length")
        return own(text(b"warc-record-id")), int(size) if size and size.isdigit() else None, noted[2] or None, kind, own(text(b"warc-refers-to")), None, text(b"warc-record-id"), text(b"warc-target-uri")
    if (text(b"content-type") or "").startswith("application/http"):
        block = block.partition(BLANK)[2]
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    verified = digest == noted[2] if noted[0].lower() == "sha1" else None
    return own(text(b"warc-record-id")), len(block), digest, kind, None, verified, text(b"warc-record-id"), text(b"warc-target-uri")


def splits(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """(file, block) and the bytes between magics, for each split of a partition in order."""

    def rows() -> Iterator[tuple[str, int, bytes]]:
        for batch in found:
            values = batch.column(2)
            for i, (file, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                yield file, block, values[i].as_py()

    for key, some in groupby(rows(), lambda r: r[:2]):
        yield key, (r[2] for r in some)


def scan(block: int, chunks: Iterator[bytes]) -> tuple:
    """Of a split: its bytes and magics in total; candidates and the place that each header leads to; those with an open header and it; what a header open before would need.

    Places count from the split's first byte, before which a magic lies but in a file's first split.
    """
    at, pos, to, waiting, text, text_at, lead, leading = 0, [], [], [], b"", 0, b"", block > 0
    for k, value in enumerate(chunks):
        some = value[:HEADER]
        if leading:
            lead += MAGIC + some
            stop = lead.find(BLANK)
            leading = stop < 0 and len(lead) < HEADER
            lead = lead[: stop + 4] if stop >= 0 else lead
        candidate = bool(k or block) and value[:3] in (b"0\r\n", b"1\r\n")
        if candidate and not waiting:
            text, text_at = b"", at - len(MAGIC)
        if candidate:
            waiting.append(at - len(MAGIC))
        if waiting:
            seen = len(text)
            text += MAGIC + some
            stop = text.find(BLANK, max(0, seen - 3))
            if stop >= 0:
                for p in waiting:
                    n = length_of(text[p - text_at : stop])
                    pos.append(p)
                    to.append(text_at + stop + 4 + n + 4 if n >= 0 else -1)
                waiting = []
            elif len(value) > HEADER or len(text) > HEADER:
                waiting = [p for p in waiting if len(value) <= HEADER and text_at + len(text) - p <= HEADER]
                text, text_at = (text[waiting[0] - text_at :], waiting[0]) if waiting else (b"", 0)
        at += len(value) + len(MAGIC)
    return at, np.array(pos, np.int64), np.array(to, np.int64), np.array(waiting, np.int64), text if waiting else b"", lead


def led(pos: np.ndarray, to: np.ndarray, end: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate the first place at or beyond end, or with an open header, that its chain leads to (-1: none), and the last record before it."""
    n = len(pos)
    if not n:
        return pos, pos
    at = np.searchsorted(pos, to)
    inside = (at < n) & (pos[np.minimum(at, n - 1)] == to)
    leaves = (to >= end) | np.isin(to, open_)
    jump = np.append(np.where(inside, at, np.where(leaves, np.arange(n), n)), n)  # who leaves stays, n is nowhere
    while (jump[jump] != jump).any():
        jump = jump[jump]
    last = jump[:n]
    ok = last < n
    last = np.where(ok, last, 0)
    return np.where(ok, to[last], -1), pos[last]


def candidates(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block), chunks in splits(found):
        total, pos, to, open_, text, lead = scan(block, chunks)
        exits, last = led(pos, to, total - len(MAGIC), open_)
        ok = exits >= 0
        values = [[file], [block], [total], [pos[ok]], [exits[ok]], [last[ok]], [open_], [text], [lead]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.binary()), strict=True)], [x.split()[0] for x in SPLITS.split(", ")])


def continued(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, exit of candidates whose header ends in the next split."""
    for batch in found:
        for file, block, base, open_, text, more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            whole = text + (more or b"")
            stop = whole.find(BLANK, max(0, len(text) - 3))
            n = [length_of(whole[p - open_[0] : stop]) if stop >= 0 else -1 for p in open_]
            rows = [(file, block, base + p, base + open_[0] + stop + 8 + k, base + p) for p, k in zip(open_, n, strict=True) if k >= 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["file", "block", "at", "exit", "last"])


def chain(parts: DataFrame) -> DataFrame:
    """file, block, base (of each split in its file), entry (where the chain first meets it, or null), owner (the record on the chain before that, or null).

    parts: SPLITS, a row for each split.
    """
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    bases = written(parts.select("file", "block", "total", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.lead("lead").over(by_file).alias("more")), "warc-bases")
    held = parts.drop("total", "lead").join(bases.drop("more"), ["file", "block"])
    moved = held.select("file", "block", "base", F.inline(F.arrays_zip("pos", "exit", "last")))
    jumps = moved.select("file", "block", *[(F.col("base") + F.col(x)).alias(y) for x, y in (("pos", "at"), ("exit", "exit"), ("last", "last"))])
    over = parts.where(F.size("open") > 0).select("file", "block", "open", "open_text").join(bases, ["file", "block"])
    over = over.select("file", "block", "base", "open", "open_text", "more").mapInArrow(continued, "file string, block long, at long, exit long, last long")
    jumps = written(jumps.unionByName(over), "warc-jumps")
    files = bases.groupBy("file").agg((F.sum("total") - len(MAGIC)).alias("size")).where("size > 0")
    wanted = jumps.select("file", F.col("exit").alias("at")).unionByName(files.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    entries = written(jumps.join(wanted, ["file", "at"], "left_semi"), "warc-entries")
    reached, jump = entries.where("at = 0").select("file", "at"), entries.select("file", "at", F.col("exit").alias("to"))
    most = entries.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most))):
        reached = written(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        jump = written(jump.join(further, ["file", "to"], "left").select("file", "at", F.coalesce("next", "to").alias("to")), "warc-jump")
    on = written(entries.join(reached, ["file", "at"], "left_semi"), "warc-chain")
    whole = on.select("file", F.col("exit").alias("size")).join(files, ["file", "size"], "left_semi")
    broken = files.join(whole, "file", "left_anti").limit(1).collect()
    if broken:
        raise ValueError(f"the chain of records of {broken[0]['file']} breaks before its end")
    met = on.groupBy("file", "block").agg(F.min("at").alias("entry"), F.max("last").alias("last"))
    return bases.select("file", "block", "base").join(met, ["file", "block"], "left").select("file", "block", "base", "entry", F.last("last", True).over(before).alias("owner"))


def walk(block: int, base: int, entry: int, owner: int, chunks: Iterator[bytes]) -> Iterator[tuple[int, int, bytes, bool]]:
    """(record, place, bytes, whether that is all of it) of the records of a split that lie on the chain."""
    record, place, held, stop = owner if owner >= 0 else None, base - len(MAGIC), [], None
    expected, at = entry, base
    for k, value in enumerate(chunks):
        magic = at - len(MAGIC)
        if magic == expected:
            if held and record is not None:
                yield record, place, b"".join(held), stop is not None and record == place
            record, place, held, stop, expected = magic, magic, [], None, -1
        held.append(MAGIC + value if k or block else value)
        if stop is None and record == place:
            raw = held[0] if len(held) == 1 else b"".join(held)
            end = raw.find(BLANK)
            if end >= 0:
                expected = stop = place + end + 4 + length_of(raw[:end]) + 4
        at += len(value) + len(MAGIC)
    if held and record is not None:
        yield record, place, b"".join(held), stop is not None and stop == at - len(MAGIC)


def batch_of(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(_TYPES), _TYPES, strict=True)]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path: file, start (its offset), and READ."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    parts = written(text.mapInArrow(candidates, SPLITS), "warc-splits")
    known = chain(parts).select(F.xxhash64("file", "block").alias("split"), "base", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce("owner", F.lit(-1)).alias("owner")).toArrow()
    # 32 bytes for each split of the archives.
    at = np.argsort(known["split"].to_numpy())
    shared = packed(spark, [known[c].to_numpy()[at] for c in ("split", "base", "entry", "owner")])
    text = text.withColumn("split", F.xxhash64("file", "block")).select("file", "block", "value", "split")

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bases, entries, owners = unpacked(shared)
        split = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in found:
                split.update(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(3).to_pylist(), strict=True))
                yield batch

        for (file, block), chunks in splits(noted()):
            i = int(np.searchsorted(names, split.pop((file, block), 0)))
            rows, heads, pieces = [], [], []
            for record, place, raw, all_ in walk(block, int(bases[i]), int(entries[i]), int(owners[i]), chunks):
                heads.append((file, record, place))
                pieces.append(None if all_ else raw)
                end = raw.find(BLANK)
                rows.append(parsed(raw[: end + 4 + length_of(raw[:end])]) if all_ else (None,) * len(_NAMES))
                if len(rows) == 1000 or not all_:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*heads, strict=True)] + [pa.array(pieces, pa.binary()), *batch_of(rows)], ["file", "start", "place", "piece", *_NAMES])
                    rows, heads, pieces = [], [], []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*heads, strict=True)] + [pa.array(pieces, pa.binary()), *batch_of(rows)], ["file", "start", "place", "piece", *_NAMES])

    found = written(text.mapInArrow(read, f"file string, start long, place long, piece binary, {', '.join(READ)}"), "warc-read")
    parts = found.where("piece is not null").groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"))

    def put_together(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            rows = []
            for pieces in batch.column(2).to_pylist():
                raw = b"".join(p["piece"] for p in pieces)
                end = raw.find(BLANK)
                rows.append(parsed(raw[: end + 4 + length_of(raw[:end])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *batch_of(rows)], ["file", "start", *_NAMES])

    return found.where("piece is null").drop("place", "piece").unionByName(parts.mapInArrow(put_together, f"file string, start long, {', '.join(READ)}"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    release(spark)
    digest = F.when(F.col("verified") | F.col("verified").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload doesn't have the digest in its header")))
    return read_warc(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")

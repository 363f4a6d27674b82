"""Byte ranges merged as a stream, against sets of blocks."""

import random

from geoloom.operators import fetching


def test_ranges_equal_sets_of_blocks(spark):
    """Requests that hold others, follow each other or repeat, cut by batches at any row; a file without a name."""
    rng = random.Random(5)
    rows = [(rng.choice(("a", "b", "c", None)), rng.randrange(4000), rng.choice((0, 1, 10, 11, 300))) for _ in range(600)]
    rows += [("long", 0, 5000), *(("long", k * 10, 10) for k in range(100)), ("long", 5000, 1), ("one", 7, 3)]
    want = set()
    for file in {r[0] for r in rows}:
        blocks = {b for f, at, n in rows if f == file and n > 0 for b in range(at // 10, (at + n - 1) // 10 + 1)}
        starts = sorted(b for b in blocks if b - 1 not in blocks)
        want |= {(file, b * 10, next(e for e in range(b, 9999) if e not in blocks) * 10) for b in starts}
    for n in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got = fetching.range_reads(spark.createDataFrame(rows, "file string, offset long, length long"), 10)
        found = [tuple(r) for r in got.collect()]
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(found) == len(set(found)) and set(found) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Generate" not in plan  # no task holds a table of blocks

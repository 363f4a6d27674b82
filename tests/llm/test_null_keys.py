"""Rows without a key, beside repeated rows and rows that share a key, pass every operator with a result of their own."""

import pytest

from geoloom.llm import decontaminate, langid, mixing, quality, rules, sharding, simhash, suffixes, suffixtree

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [(None, LONG, None, None), (None, None, "en", "a"), (5, LONG, "en", None), (5, LONG, "en", None), (5, "another text of the same key " * 3, "en", "a"), (6, LONG, "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


def test_counts_and_keys(docs):
    for out in (
        mixing.mix(docs),
        rules.judge(docs),
        suffixtree.score(docs, docs),
        langid.predict(docs, langid.train(docs)),
        quality.score(docs, None),
        sharding.shard(docs),
        simhash.near_duplicates(docs),
        simhash.similar(docs),
    ):
        assert sorted(str(r.doc_id) for r in out.collect()) == ["5", "5", "5", "6", "None", "None"]


def test_suffixes_leave_rows_without_a_key(docs):
    got = sorted(((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.removed(docs).collect()))
    n, other = len(LONG), len("another text of the same key " * 3)
    assert got == sorted([("None", n, 0), ("None", 0, 0), ("5", n, 0), ("5", n, 0), ("5", other, 0), ("6", n, n)])


def test_components_without_a_key(docs):
    got = {(r.doc_id, r.fp == 0): r.root for r in simhash.near_duplicates(docs).collect()}
    assert got[None, False] == got[5, False] == got[6, False] == 5 and got[None, True] is None


def test_representatives_keep_rows_without_a_key(docs):
    assert sorted(str(r.doc_id) for r in simhash.representatives(docs).collect()) == ["5", "5", "None", "None"]  # one of each group: key 5 has texts of two


def test_decontamination_without_a_key(spark, docs):
    bench = spark.createDataFrame([(1, LONG), (None, "other " * 9)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.overlaps(docs, bench).collect()) == ["5", "5", "6", "None"]
    assert decontaminate.clean(docs, bench).count() == 2

"""The pipeline's stages on a small table, each against brute force on its own input."""

import random

import pytest

import corpus_pipeline
from geoloom.llm import mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def text_of(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rng = random.Random(1)
    rows, bench = [], [(i, text_of(rng, 30)) for i in range(6)]
    for i in range(400):
        text, kind = text_of(rng, rng.randint(30, 120)), "clean"
        if i % 10 == 1:
            text, kind = " ".join(w + "%%%" for w in text.split()), "junk"
        elif i % 10 == 2:
            text, kind = rows[rng.randrange(len(rows) // 10 + 1) * 10][1], "copy"
        elif i % 10 == 3:
            text, kind = f"{text} {bench[i % 6][1]} {text_of(rng, 20)}", "leak"
        rows.append((i, text, "en", f"s{rng.randrange(4)}" if i % 3 else "hot", len(text), kind))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string")
    frame.drop("kind").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[5] != "junk"), 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {r[0]: r for r in rows}


def test_stages(spark, corpus):
    path, rows = corpus
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kinds = lambda *names: sorted(i for i, r in rows.items() if r[5] in names)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    good = stages["quality"](spark, docs, path).cache()
    assert good.columns == COLUMNS and ids(good) == kinds("clean", "copy", "leak")
    one = stages["near_duplicates"](spark, good, path).cache()
    assert one.columns == COLUMNS and ids(one) == kinds("clean", "leak")
    clean = stages["decontamination"](spark, one, path).cache()
    assert clean.columns == COLUMNS and ids(clean) == kinds("clean")
    mixed = stages["mixing"](spark, clean, path).cache()
    assert mixed.columns == COLUMNS
    times = {r.doc_id: r.repeats for r in mixing.mix(clean).collect()}
    assert ids(mixed) == sorted(i for i, n in times.items() for _ in range(n))
    last = stages["sharding"](spark, mixed, path).collect()
    assert len(last) == mixed.count()
    for s in range(corpus_pipeline.SHARDS):
        slots = sorted(r.slot for r in last if r.shard == s)
        assert slots == list(range(len(slots)))


def test_stages_take_odd_rows(spark, corpus):
    """Nulls in every column, repeated rows, empty and extra columns, and an empty table pass every stage."""
    path, _ = corpus
    odd = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, "x"), (1, "", "en", None, 0, "x"), (2, "a b c d e f g h", None, "s", 15, "x"), (2, "other text of the same id", None, "s", 25, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string"
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, []):
            out = stage(spark, spark.createDataFrame(rows, schema), path)
            assert out.columns[:5] == COLUMNS, name
            assert out.count() <= 3 * len(rows)


def test_mixing_takes_repeated_rows_as_often_as_the_mix_does(spark, corpus):
    """Rows of one doc_id, some equal: the words taken are those of the mix, to the row."""
    path, _ = corpus
    rng = random.Random(3)
    texts = [text_of(rng, 20) for _ in range(6)]
    rows = [(1, texts[0], "en", "a", 1)] * 5 + [(1, texts[1], "en", "a", 1)] * 2 + [(2, texts[2], "en", "a", 1)] + [(None, texts[i % 6], None, "b", 1) for i in range(30)] + [(3, " ", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    got, again = (sorted(map(str, stage(spark, x, path).collect())) for x in (docs, docs.repartition(5)))
    assert got == again and len(got) == sum(r.repeats for r in mixing.mix(docs).collect())

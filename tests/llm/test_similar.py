"""The pipeline's near-duplicates: fingerprints first, sketches before whole sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import common, simhash


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(3)
    for _ in range(300):
        both, a, b = (rng.integers(-(1 << 63), 1 << 63, int(n)) for n in rng.integers(0, 400, 3))
        a, b = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        bits = simhash.apart(simhash.sketch(a)[None], simhash.sketch(b)[None])[0]
        assert bits <= len(np.setxor1d(a, b))
        if min(len(a), len(b)) > 50 and len(np.intersect1d(a, b)) < len(a) / 4 and 0.8 < len(a) / len(b) < 1.25:
            assert 9 * bits > len(a) + len(b)


def test_possible_keeps_every_similar_pair(spark):
    rng = random.Random(5)
    sets = []
    for i in range(120):  # pairs at and around a similarity of 0.8, and sets of one element or none
        n = rng.choice((1, 4, 9, 63, 64, 65, 200, 900))
        base = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
        extra = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.choice((0, n // 4, n // 4 + 1, n // 3)))]
        sets += [(2 * i, base), (2 * i + 1, base + extra)]
    sets.append((240, []))
    table = spark.createDataFrame([(i, len(x), simhash.sketch(np.array(x, np.int64)).tolist()) for i, x in sets], "node long, n int, sketch array<long>")
    pairs = [(2 * i, 2 * i + 1) for i in range(120)] + [(240, i) for i in range(8)] + [(2 * i, 2 * i + 3) for i in range(119)]
    got = {(r.a, r.b) for r in simhash.possible(spark.createDataFrame(pairs, "a long, b long"), table).collect()}
    held = {i: set(x) for i, x in sets}
    similar = {(a, b) for a, b in pairs if 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b])}
    assert similar <= got and len(got) < len(similar) + 80 and not any(a == 240 for a, _ in got)


def test_linked_joins_what_the_check_leaves(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 7), (9, 1 << 62)], "node long, fp long")
    near = lambda a, b: simhash.close(a, b, 4)
    got = lambda check: {r.node: r.root for r in simhash.linked(nodes, simhash.cells, near, check).collect()}
    assert got(None) == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1}
    both = lambda pairs, some: pairs.where(F.array_sort(F.array("a", "b")).isin([F.array(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in some]))
    assert got(lambda pairs: both(pairs, [(1, 2), (3, 4)])) == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9}


def test_similar_texts_meet_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(str(rng.random()) for _ in range(300)) for _ in range(6)]
    rows = [(i, x) for i, x in enumerate([*texts, *[f"{x} end" for x in texts]])]
    met, linked = [], simhash.linked

    def noted(*args):
        found = linked(*args)
        met.append({r.node: r.root for r in found.collect()})
        return found

    monkeypatch.setattr(simhash, "linked", noted)
    got = {r.doc_id: r.root for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 6 for i in range(12)}
    assert len(met) == 1 and all(root in (i, i % 6) for i, root in met[0].items())
    assert sum(met[0][i] == i - 6 for i in range(6, 12)) >= 4  # a word more may flip more than DISTANCE bits


def variants() -> list[tuple[int, str]]:
    """Texts and copies of them with words exchanged or appended or as they are, some under another's doc_id."""
    rng = random.Random(11)
    texts = []
    for _ in range(14):
        words = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.randrange(40, 120))]
        texts.append(words)
        for _ in range(rng.randrange(4)):
            other = list(words)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(len(other))] = "new"
            texts.append(other + [str(rng.random()) for _ in range(rng.randrange(12))])
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    return [*rows, *[(i + 1, x) for i, x in rows[::5]], *[(i + 100, x) for i, x in rows[::4]]]


def roots(rows: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """doc_id and the least doc_id of its group for each row, by all pairs."""
    sets, up = [set(simhash.shingles(x.encode(), 5).tolist()) for _, x in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                up = [up[j] if x == up[i] else x for x in up]
    return sorted((key, min(k for (k, _), x in zip(rows, up, strict=True) if x == own)) for (key, _), own in zip(rows, up, strict=True))


def test_rows_are_chosen_by_bits_or_by_a_join(spark, monkeypatch):
    rows = [0, 5, 63, 64, (1 << 40) + 1, (7 << 40) + 200]
    sets = spark.createDataFrame([(x,) for x in rows], "row long")
    asked = sorted({x + k for x in rows for k in (0, 1, 64)} | {1 << 50})
    prints = spark.createDataFrame([(str(x), x, [x]) for x in asked], "name string, row long, hashes array<long>")
    assert simhash.in_rows(simhash.row_bits(sets), np.array(asked)).tolist() == [x in rows for x in asked]
    assert not simhash.in_rows(simhash.row_bits(sets.limit(0)), np.array(asked)).any()
    expected = [(x, str(x), [x]) for x in asked if x in rows]
    assert sorted(map(tuple, simhash.chosen(prints, sets).select("row", "name", "hashes").collect())) == expected
    assert "Exchange" not in simhash.chosen(prints, sets)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "MOST_CHOSEN", 3)
    assert sorted(map(tuple, simhash.chosen(prints, sets).select("row", "name", "hashes").collect())) == expected


def test_maps_of_other_sizes(spark):
    hashes = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 3000)
    table = spark.createDataFrame([(int(x),) for x in hashes[:1000]], "token long")
    for bits in (16, 20, common.MAP_BITS):
        made = common.bitmap(table, bits)
        found = common.mapped(made, hashes)
        assert len(made) * 64 == 1 << bits and found[:1000].all() and found[1000:].mean() < 2 * 1000 / (1 << bits) + 0.01


def test_shingles_of_one_group_alone_do_not_travel(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(str(rng.random()) for _ in range(600)) for _ in range(6)]
    rows = [(i, x) for i, x in enumerate([*texts, *[f"{x} end" for x in texts]])]  # pairs that mostly meet by fingerprints
    grids, met, written, linked = [], [], simhash.written, simhash.linked

    def noted(df, tag, *more):
        out = written(df, tag, *more)
        if tag == "similar-grid":
            grids.append([r.node for r in out.collect()])
        return out

    def met_first(*args):
        out = linked(*args)
        met.append({r.node: r.root for r in out.collect()})
        return out

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(simhash, "linked", met_first)
    got = {r.doc_id: r.root for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 6 for i in range(12)}
    joined = {i for i, root in met[0].items() if root != i} | {root for i, root in met[0].items() if root != i}
    assert len(joined) >= 8 and not joined & set(grids[0])


def test_groups_by_bits_and_by_joins(spark, monkeypatch):
    rows = variants()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = roots(rows)
    assert sorted((r.doc_id, r.root) for r in simhash.similar(table).collect()) == expected
    for name in ("MOST_CHOSEN", "FEW"):
        monkeypatch.setattr(simhash, name, 0)
    assert sorted((r.doc_id, r.root) for r in simhash.similar(table).collect()) == expected

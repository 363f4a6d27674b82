"""The text operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from geoloom.llm import decontaminate, langid, mixing, quality, rules, sharding, simhash, suffixes, suffixtree, warc
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, `key` string"
VOWELS = {"en": "aeiou", "fr": "éèêaou", "de": "äöüaei"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice("bcdfghlmnrst") + rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, junk, and the edge cases; ids with a repeated row."""
    rng = random.Random(5)
    out = []
    passage = sentence(rng, "en", 30)
    for i in range(150):
        lang = rng.choice(list(VOWELS))
        text = sentence(rng, lang, rng.randint(12, 90)).capitalize()
        if i % 9 == 1:
            text = out[rng.randrange(len(out))][1]
        elif i % 9 == 2:
            words = out[rng.randrange(len(out))][1].split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 9 == 3:
            text = f"{text}\n{passage}\n{sentence(rng, 'en', 5)}"
        elif i % 9 == 4:
            text = " ".join(w + rng.choice("#$%&") * 3 for w in text.split())
        out.append((i, text, lang, rng.choice(["a", "b", "é", None])))
    out += [(200, None, "en", "a"), (201, "", "en", "a"), (202, " \n\t", None, "b"), (203, "42 !!", "de", "b"), (204, "nul\0 in it " * 9, "en", "a"), (205, sentence(rng, "fr", 9000), "fr", "b"), (206, "xy " * 400, "en", "a"), (7, out[7][1], *out[7][2:])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "clash", "clash", "clash") for i, t, l, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_mixing_reaches_targets(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, targets, taken = Counter(), {}, Counter()
    for r in got:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.size * r.repeats
        assert 0 <= r.repeats <= 3
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = mixing.fill_targets([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))], sum(sizes.values()))
    assert [targets[s] for s in order] == pytest.approx(want)
    for s in order:  # one document has 9000 words: no subset may come nearer than some of its size
        assert abs(taken[s] - targets[s]) <= (1 if s != "b" else 4500)
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(words(t))) for i, t, *_ in rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0


def test_targets_are_capped_and_reshared():
    assert mixing.fill_targets([10, 100, 100], [10, 1, 1], 210) == pytest.approx([30, 90, 90])
    assert mixing.fill_targets([0, 5], [1, 1], 5) == pytest.approx([0, 5])
    assert mixing.fill_targets([], [], 0) == []


def test_knapsack_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randint(0, 4) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        budget = rng.randint(0, 90)
        used = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= u <= c for u, c in zip(used, counts))
        assert sum(u * n for u, n in zip(used, lengths)) == min(sums, key=lambda s: (abs(s - budget), s))
        whole, once = mixing.fit(lengths, counts, budget, bits=16)
        assert all(0 <= u <= c for u, c in zip(once, counts)) and whole <= 3


def test_mixing_of_long_texts_takes_the_nearest_sum():
    assert mixing.fit([600000], [10], 450000) == (0, [1])
    assert mixing.fit([600000], [10], 250000) == (0, [0])
    lengths, counts = [30_000_001, 5_000_003, 17, 3], [3, 4, 1000, 1000]
    _, once = mixing.fit(lengths, counts, 40_000_000)
    assert abs(sum(a * b for a, b in zip(lengths, once)) - 40_000_000) <= 10
    even = [2 * i + 2 for i in range(3000)]
    assert sum(a * b for a, b in zip(even, mixing.fit(even, [1] * 3000, 500_001)[1])) in (500_000, 500_002)


def test_targets_of_many_sources():
    rng = random.Random(2)
    sizes, weights = [rng.randrange(1000) for _ in range(20000)], [rng.randint(1, 3) for _ in range(20000)]
    got = mixing.fill_targets(sizes, weights, sum(sizes))
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * n + 1e-6 for t, n in zip(got, sizes))
    level = max(t / w for t, w in zip(got, weights))
    assert all(t == pytest.approx(min(3 * n, level * w)) for t, n, w in zip(got, sizes, weights))


def test_mixing_counts_rows_of_one_key(spark):
    """A third of the rows has one key and text: they are taken by number, and every row comes back."""
    rows = [(5, "a b c", "s")] * 300 + [(100 + i, "d e f", "s") for i in range(300)] + [(None, "one two", None)] * 400
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 1000
    for source in ("s", None):
        some = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.repeats for r in some) - some[0].target) <= 3


def removed_by_brute_force(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def test_suffixes_against_brute_force(docs, rows, empty):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.removed(docs).collect())
    assert got == removed_by_brute_force(rows)
    assert suffixes.removed(empty).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_suffixes_of_small_alphabets(spark, alphabet):
    """Periodic and highly repetitive texts: many long common prefixes, windows at every offset."""
    rng = random.Random(len(alphabet))
    base = "".join(rng.choice(alphabet) for _ in range(300))
    rows = []
    for i in range(40):
        text = "".join(base[(p := rng.randrange(240)) : p + rng.randint(20, 60)] for _ in range(rng.randint(1, 8)))
        rows.append((i, rng.choice([text, "ab" * 60 + text, "a" * rng.randint(0, 200)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.removed(df).collect())
    assert got == removed_by_brute_force(rows)


def test_deep_shallow_sorts_and_measures():
    rng = np.random.default_rng(1)
    strings = rng.integers(0, 2, (400, 56), np.uint8)
    strings[rng.integers(0, 400, 300), :40] = strings[0, :40]
    group = rng.integers(0, 3, 400)
    order, common = suffixes.deep_shallow(group, strings)
    rows = [(int(g), s.tobytes()) for g, s in zip(group, strings)]
    assert [rows[i] for i in order] == sorted(rows)
    for k in range(1, 400):
        (g, a), (h, b) = rows[order[k - 1]], rows[order[k]]
        same = next((i for i in range(56) if a[i] != b[i]), 56)
        assert common[k] == (same if g == h else -1)


def test_suffixtree_against_brute_force(docs, rows, empty):
    train = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in words((t or "").translate(LOWER)))
    counts["\n"] = len(train)
    n, v = sum(counts.values()), len(counts)
    got = suffixtree.score(docs, docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)).collect()
    want = {}
    for i, t, *_ in rows:
        tokens = [*words((t or "").translate(LOWER)), "\n"]
        want[i] = (len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)
    assert suffixtree.score(empty, empty).count() == 0
    assert suffixtree.score(docs, empty).agg(F.max(F.abs("score"))).first()[0] == pytest.approx(0, abs=1e-6)


def tree_gains(train, texts, depth):
    """What the tree adds to the base score of each text, by dictionaries of tuples."""
    least, gain, smooth = suffixtree.LEAST_COUNT, suffixtree.GAIN, suffixtree.SMOOTH
    symbols = lambda t: ("^", *words(t.translate(LOWER)), "$")
    lines = [symbols(t) for t in train]
    runs = lambda line, n: [line[i : i + n] for i in range(len(line) - n + 1)]
    counts = {n: Counter(x for line in lines for x in runs(line, n)) for n in range(1, depth + 2)}
    kinds = Counter(x for line in lines for x in line[1:])
    norm = sum(kinds.values()) + 0.5 * (len(kinds) + 1)
    chance = {x: (n + 0.5) / norm for x, n in counts[1].items() if n >= least}
    gains, back = {}, {}
    for length in range(2, depth + 2):
        after = {}
        for x, n in counts[length].items():
            if n >= least:
                after.setdefault(x[:-1], []).append((x, n))
        for context, some in after.items():
            total, occurs = sum(n for _, n in some), counts[length - 1][context]
            won = sum(n * math.log((n - 1 + smooth * chance[x[1:]]) / (total - 1 + smooth) / chance[x[1:]]) for x, n in some)
            won += max(occurs - total, 0) * math.log(smooth / (total + smooth))
            for x, n in some:
                chance[x] = (n + smooth * chance[x[1:]]) / (total + smooth) if won >= gain else chance[x[1:]]
            if won >= gain:
                back[context] = math.log10(smooth / (total + smooth))
                gains |= {x: math.log10(chance[x] / chance[x[1:]]) - back[context] for x, _ in some}
    out = []
    for t in texts:
        line = symbols(t)
        out.append(sum(gains.get(x, 0) for n in range(2, depth + 2) for x in runs(line, n)) + sum(back.get(x, 0) for n in range(1, depth + 1) for x in runs(line, n)))
    return out, back


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffixtree_against_dictionaries(spark, docs, rows, depth):
    rng = random.Random(31)
    vocabulary = [sentence(rng, "en", 1) for _ in range(6)]
    phrases = [" ".join(rng.choices(vocabulary, k=9)) for _ in range(5)]
    train = [" ".join(rng.choice([*phrases, f"rare{rng.randrange(900)}"]) for _ in range(5)) for _ in range(400)]
    texts = [*train[:50], "", "unseen words only", *(t or "" for _, t, *_ in rows[:20])]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score - r.base_score for r in suffixtree.score(frame(texts), frame(train), depth=depth).collect()}
    want, kept = tree_gains(train, texts, depth)
    assert {len(x) for x in kept} == set(range(1, depth + 1))
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)


def test_word_hashes_are_of_words():
    parts = [b"", b"A b\x0bc", b" \n", b"x" * 200000 + b" yy " + b"X" * 200000, "é\x1cn\x00".encode(), b"b a"]
    hashes, sizes = suffixtree.word_hashes(parts)
    each = [w for x in parts for w in x.lower().split()]
    assert sizes.tolist() == [len(x.split()) for x in parts] and len(hashes) == len(each)
    assert len(set(hashes.tolist())) == len(set(each)) == len(set(zip(hashes.tolist(), each)))
    some = np.unique(hashes.view(np.uint64))
    table = suffixtree.Lookup(some.view(np.int64)[::2], np.arange(len(some))[::2])
    assert [int(table.values[i]) if i >= 0 else -1 for i in table.find(some.view(np.int64))] == [i if i % 2 == 0 else -1 for i in range(len(some))]
    assert suffixtree.Lookup(hashes[:0], hashes[:0]).find(hashes).max() == -1


@pytest.mark.parametrize("most", [0, 400, 10**6])
def test_suffixtree_keeps_what_occurs_three_times_in_a_large_corpus(spark, most):
    """A phrase of three texts among 400,000 tokens is gathered; all of the tree broadcast, part of it, none."""
    rng = random.Random(21)
    phrase = "quite rare words that follow one another"
    vocabulary = [sentence(rng, "en", 1) for _ in range(3000)]
    train = [" ".join(rng.choices(vocabulary, k=100)) + (f" {phrase}" if i in (5, 600, 3900) else "") for i in range(4000)]
    texts = [phrase, "rare that one", "", None, *train[:40]]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score - r.base_score for r in suffixtree.score(frame(texts), frame(train), most=most, most_words=most).collect()}
    want, _ = tree_gains(train, [t or "" for t in texts], suffixtree.DEPTH)
    assert want[0] > 10
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)


def counted(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)})


def test_rules_counts_and_verdicts(docs, rows, empty):
    got = rules.judge(docs).collect()
    assert sorted((r.doc_id, *r[1:6]) for r in got) == sorted((i, *counted(t)) for i, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    junk = {i for i, t, *_ in rows if i < 150 and sum(c in "#$%&" for c in t) > len(words(t))}
    assert junk and not any(r.kept for r in got if r.doc_id in junk)
    clean = [r.kept for r in got if r.doc_id < 150 and r.doc_id not in junk]
    assert sum(clean) == len(clean)
    assert rules.judge(empty).count() == 0


def test_rules_estimate_is_the_least_determinant(spark):
    """On a contaminated normal sample the estimate has the location and scatter of the clean part."""
    rng = np.random.default_rng(2)
    clean = rng.multivariate_normal([5, 1, 1, 1], np.diag([1, 0.25, 1, 0.5]) + 0.2, 2000)
    bad = rng.normal([15, 9, 9, 9], 0.1, (300, 4))
    rows = [(0, "a", "b", *map(float, x)) for x in np.vstack([clean, bad])]
    df = spark.createDataFrame(rows, "level int, g0 string, g1 string, x0 double, x1 double, x2 double, x3 double")
    r = rules.estimate(df).first()
    assert [r[f"m{i}"] for i in range(4)] == pytest.approx([5, 1, 1, 1], abs=0.2)
    factor = np.array([[r[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    assert factor @ factor.T == pytest.approx(np.diag([1, 0.25, 1, 0.5]) + 0.2, abs=0.35)


def test_rules_estimate_against_every_subset(spark, monkeypatch):
    """Groups of 20 rows, some with outliers: the determinant against the least of all subsets of 15."""
    from itertools import combinations

    monkeypatch.setattr(rules, "FLOORS", (1e-6,) * 4)
    rng = np.random.default_rng(7)
    subsets = np.array(list(combinations(range(20), 15)))
    samples = [np.vstack([rng.normal(0, 1, (20 - k, 4)), rng.normal(8, 0.3, (k, 4))]) for k in (0, 2, 4, 5, 3, 5)]
    rows = [(0, str(g), "b", *map(float, x)) for g, sample in enumerate(samples) for x in sample]
    df = spark.createDataFrame(rows, "level int, g0 string, g1 string, x0 double, x1 double, x2 double, x3 double")
    got = {int(r.g0): r for r in rules.estimate(df).collect()}
    tail = rules.chi2_quantile(0.25, 2)
    widen = 0.75 / (1 - rules.chi2_tail(tail, 3))
    ratios = []
    for g, sample in enumerate(samples):
        parts = sample[subsets] - sample[subsets].mean(1, keepdims=True)
        least = np.linalg.det(np.einsum("ski,skj->sij", parts, parts) / 15).min()
        factor = np.array([[got[g][f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        ratios.append(np.linalg.det(factor @ factor.T) / widen**4 / least)
        assert max(abs(got[g][f"m{i}"]) for i in range(4)) < 1.5  # no outlier is among the nearest
    assert all(0.99 <= x <= 3 for x in ratios) and sorted(ratios)[len(ratios) // 2] <= 1.5, ratios


def test_langid_held_out_accuracy(docs, rows, empty):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs.where(~held_out))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    junk = {200, 201, 202, 203}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in junk)
    held = [(i, l) for i, t, l, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2 and i < 150]
    # Copies carry another document's language with their text.
    right = sum(got[i].lang_pred == l for i, l in held if i % 9 not in (1, 2))
    assert right >= 0.95 * sum(i % 9 not in (1, 2) for i, _ in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    many = langid.MOST_LANGUAGES
    for block in (1, 2):  # languages in blocks give the same
        langid.MOST_LANGUAGES = block
        again = {r.doc_id: r for r in langid.predict(docs, model).collect()}
        assert all(again[i].lang_pred == got[i].lang_pred and again[i].score == pytest.approx(got[i].score) for i in got)
    langid.MOST_LANGUAGES = many
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x, 42) for x in ([" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs, rows, empty):
    prints = [(i, fingerprint(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in prints}
    for _ in range(len(prints)):
        before = dict(root)
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    got = sorted((r.doc_id, r.fp % 2**64, r.root) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((i, f, root[i]) for i, f in prints)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_bounds_and_dense_cells(spark):
    """Chains and balls of fingerprints: every link within the distance counts, none beyond it; ties and signs."""
    rng = random.Random(9)
    prints, centre = [], rng.getrandbits(64)
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        prints.append(x)
    prints += [rng.getrandbits(64) for _ in range(50)] + [0, 2**64 - 1, 2**63, 15, 31]
    table = sorted(set(prints))
    root = {x: i for i, x in enumerate(table)}
    for _ in table:
        before = dict(root)
        for a in table:
            for b in table:
                if (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    signed = lambda x: x - 2**64 if x >> 63 else x
    nodes = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(table)], "node long, fp long")
    got = {r.node: r.root for r in simhash.linked(nodes, simhash.cells, lambda a, b: simhash.close(a, b, 4)).collect()}
    assert got == {i: root[x] for i, x in enumerate(table)}
    for blocks, distance in ((8, 4), (10, 4), (6, 2)):  # other grids find the same
        again = {r.node: r.root for r in simhash.linked(nodes, lambda x: simhash.cells(x, blocks, distance), lambda a, b: simhash.close(a, b, distance)).collect()}
        assert again == got or distance < 4
    pair = spark.createDataFrame([(signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for _ in range(200)], "a long, b long")
    r = pair.select("a", "b", simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))).alias("m"))
    for a, b, m in r.collect():
        assert m == sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)) <= ((a ^ b) % 2**64).bit_count()


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(139, 200), (300, 300), (7, 5), (500, 501), (501, 500)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 140), 200]} | {500: 500, 501: 500}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_groups(docs, rows, empty):
    shingles = {i: {tuple(w[k : k + 5]) for w in [words((t or "").translate(LOWER))] for k in range(max(1, len(w) - 4))} for i, t, *_ in rows}
    got = {r.doc_id: r.root for r in simhash.similar(docs).collect()}
    for i in shingles:
        for j in shingles:
            share = len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])
            if share >= 0.93:
                assert got[i] == got[j]
    alone = [i for i in shingles if all(i == j or not shingles[i] & shingles[j] for j in shingles)]
    assert all(got[i] == i and list(got.values()).count(i) == 1 for i in alone)
    kept = [r.doc_id for r in simhash.representatives(docs).collect()]
    assert sorted(kept) == sorted(set(got.values()))
    assert simhash.representatives(empty).count() == 0


@pytest.fixture(scope="module")
def variants():
    """Texts of 6 to 60 words with words appended or exchanged, around a similarity of 0.8; a line that all of some share."""
    rng = random.Random(11)
    out = []
    line = sentence(rng, "en", 12)
    for n in [*range(6, 20), 30, 40, 60, 60]:
        for k in range(6):
            text = sentence(rng, "en", n).split()
            out.append(text)
            for j in range(1, 4):
                more = [*text, *sentence(rng, "en", j).split()]
                if k % 2 and n >= 30:
                    for _ in range(j):
                        more[rng.randrange(n)] = "changed"
                out.append(more)
    out += [[*sentence(rng, "en", rng.randint(8, 30)).split(), *line.split()] for _ in range(60)]
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def groups_of(texts):
    """The least id that links of a similarity of 0.8 or more lead to, for each id, and how many links are close to it."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts for w in [t.split()]}
    share = {(i, j): len(a & b) / len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j and a & b}
    root = {i: i for i in sets}
    top = lambda i: i if root[i] == i else top(root[i])
    for (i, j), x in share.items():
        if x >= 0.8 and top(i) != top(j):
            root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in sets}, share


def test_similar_joins_every_pair_from_the_bound_on(spark, variants):
    want, share = groups_of(variants)
    assert sum(0.8 <= x < 0.86 for x in share.values()) >= 20
    got = {r.doc_id: r.root for r in simhash.similar(spark.createDataFrame(variants, "doc_id long, text string")).collect()}
    assert not [(i, j, x) for (i, j), x in share.items() if x >= 0.8 and got[i] != got[j]]


def test_similar_joins_no_pair_below_the_bound(spark):
    """Pairs of 200 shingles at 0.70 to 0.79, which bits alone can't tell from 0.8."""
    rng = random.Random(12)
    texts = []
    for i in range(120):
        text = sentence(rng, "en", 204).split()
        more = list(text)
        for k in range(5 + i % 2):
            more[10 + 30 * k] = "changed"
        texts += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(more))]
    want, share = groups_of(texts)
    assert len(share) >= 120 and all(0.7 <= x < 0.8 for x in share.values() if x > 0.1)
    got = {r.doc_id: r.root for r in simhash.similar(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want


def test_quality_separates_and_estimates_the_prior(spark, docs, empty):
    rng = random.Random(4)
    junk = lambda: " ".join(w + "###" for w in sentence(rng, "en", 40).split()) if rng.random() < 0.5 else " ".join([sentence(rng, "en", 1)] * 50)
    rows = [(i, junk() if i % 5 == 0 else sentence(rng, "en", rng.randint(8, 80)).capitalize() + ".") for i in range(1500)]
    df = spark.createDataFrame([*rows, (None, "null key"), (1501, None)], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i, _ in rows if i % 5 and i % 3 == 0], "doc_id long")
    model = quality.train(df, good)
    assert model["prior"] == pytest.approx(0.8, abs=0.1)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows) + 2
    assert sum(got[i] >= 0.7 for i, _ in rows if i % 5) >= 0.98 * 1200
    assert sum(got[i] < 0.7 for i, _ in rows if i % 5 == 0) >= 0.98 * 300
    assert quality.train(df, good.limit(0)) is None
    assert quality.score(docs, None).agg(F.max("score")).first()[0] == 0
    assert quality.score(empty, model).count() == 0


def test_quality_learns_one_row_of_a_key(spark):
    """A hot key and repeated rows: the sample has a row for each key, and the model doesn't change with repeats."""
    rng = random.Random(14)
    rows = [(i, sentence(rng, "en", 30) if i % 4 else " ".join(w + "$$" for w in sentence(rng, "en", 20).split())) for i in range(200)]
    good = spark.createDataFrame([(i,) for i, _ in rows if i % 4 == 1], "doc_id long")
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    one = quality.train(frame(rows), good)
    many = quality.train(frame(rows + [rows[1]] * 300), good.unionByName(good))
    assert len(one["mean"]) == len(many["mean"]) and one["mean"] == pytest.approx(many["mean"])
    text = quality.train(spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string"), good)
    assert 0 < text["prior"] < 1


def test_quality_risk_is_not_negative():
    """A few positives in many dimensions: the unconstrained risk would fall without end."""
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (20, 40)), rng.normal(0, 1, (30, 40))
    model = quality.fit(p, u, prior=0.5, rounds=800, decay=0.0)
    assert np.abs(model["weights"]).max() < 50


def test_sharding_moves_few(docs, rows, empty):
    weights = (1.0, 2.0, 1.0, 0.5)
    df = sharding.shard(docs, weights=weights, grown=(*weights, 1.0))
    assert set(df.columns) == set(docs.columns) | {"shard", "slot", "grown_shard"}
    got = df.collect()
    assert len(got) == len(rows)
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    again = {r.doc_id: r.shard for r in sharding.shard(docs.repartition(7), weights=weights).collect()}
    assert all(again[r.doc_id] == r.shard for r in got)
    assert sharding.shard(empty).count() == 0
    with pytest.raises(ValueError, match="weight"):
        sharding.rendezvous(F.lit(1), ())


def test_sharding_with_clashing_names_and_a_hot_key(spark):
    rows = [(7, f"t{i % 40}", i) for i in range(400)] + [(None, f"u{i}", i) for i in range(300)] + [(i, "x", i) for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, __u string, __start long").withColumns({"__rank": F.lit("r"), "__n": F.lit(1), "a.b": F.lit(2)})
    got = sharding.shard(df, weights=(1.0, 1.0, 1.0))
    assert got.columns == [*df.columns, "shard", "slot"]
    found = got.collect()
    assert sorted(map(str, ((r.doc_id, r["__u"], r["__start"]) for r in found))) == sorted(map(str, rows)) and {r["__rank"] for r in found} == {"r"}
    for s in range(3):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    again = {(r.doc_id, r["__u"], r["__start"]): r.slot for r in sharding.shard(df.repartition(7), weights=(1.0, 1.0, 1.0)).collect()}
    assert all(again[r.doc_id, r["__u"], r["__start"]] == r.slot for r in found)


def test_keys_that_are_no_numbers_raise(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for query in (simhash.near_duplicates, simhash.similar, simhash.representatives, suffixes.removed):
        with pytest.raises(TypeError, match="whole number"):
            query(df)
    assert sharding.shard(df).count() == rules.judge(df.withColumns({"lang": F.lit("en"), "source": F.lit("a")})).count() == 1


def test_representatives_of_texts_that_share_a_key(spark):
    """Different texts of one key are of groups of their own; of equal rows one stays, whichever order they come in."""
    rng = random.Random(15)
    a, b, c_ = (sentence(rng, "en", 40) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (3, b + " more", "z"), (4, c_, "w"), (4, c_, "w"), (4, c_, "v")]
    for some in (rows, rows[::-1]):
        kept = simhash.representatives(spark.createDataFrame(some, "doc_id long, text string, note string").repartition(3)).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), (4, c_)])
        assert len({r.note for r in kept if r.doc_id == 4}) == 1
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string, note string")).collect()
    assert sorted((r.doc_id, r.root) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4)]


def test_sharding_follows_weights(spark):
    shares = {r.shard: r["count"] for r in sharding.shard(spark.range(20000).withColumnRenamed("id", "doc_id"), weights=(1.0, 3.0)).groupBy("shard").count().collect()}
    assert shares[1] / 20000 == pytest.approx(0.75, abs=0.02)


PAGE = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture
def small_splits(spark):
    """Files of some kilobytes in many splits."""
    names = {"spark.sql.files.maxPartitionBytes": "16000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def read_pages(spark, path):
    return [tuple(r) for r in warc.read_warc(spark, path).withColumnRenamed("record_id", "page_id").select(PAGE).collect()]


def test_warc_round_trip(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, None), (3, "u\r\nX: 1", ""), (4, "u", fake), (5, "u", fake + "WARC/1.0\r\n"), (6, "u", "x\r\n\r\n"), (7, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (9, "u", fake), (9, "u", fake), (10, "u", "WARC/1.0\r\nContent-Length: 99999\r\n\r\n"), (11, "u", "WARC/1."), (12, "http://x/WARC/1.0", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, f"file://{tmp_path}/out")
    got = sorted(read_pages(spark, f"file://{tmp_path}/out"), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        top = max(j for j, _, h in pages if j is not None and (h or "") == (html or ""))
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)
    warc.write_warc(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def record(kind, number, body, *more):
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + number, *more, b"Content-Length: %d" % len(body)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_of_other_makers_in_splits_and_gzip(spark, tmp_path, small_splits):
    """Records of all types, magic in payloads and headers, records over many splits, one huge one; plain and as gzip members."""
    import gzip

    rng = random.Random(13)
    fake = record(b"response", b"<urn:x>", b"abc")
    records, want = [record(b"warcinfo", b"<urn:uuid:1>", b"software: x\r\n")], [("warcinfo", "<urn:uuid:1>", 13)]
    for i in range(200):
        body = bytes(rng.choices(b"ab\r\n", k=rng.randrange(300)))
        body = rng.choice([body, body + fake, fake * rng.randint(1, 40), b"WARC/1.0\r\n" * rng.randint(1, 900), b"WARC/1." + body, body + b"\r\n\r\n"])
        if i == 100:
            body = bytes(rng.choices(b"abcd", k=200_000)) + fake + b"z" * 50_000
        kind = rng.choice([b"request", b"metadata", b"resource"])
        number = b"<urn:uuid:%d>" % (i + 2)
        records.append(record(kind, number, body, *([b"WARC-Target-URI: http://x/WARC/1.0"] * (i % 3 == 0))))
        want.append((kind.decode(), number.decode(), len(body)))
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>"
    digest = base64.b32encode(hashlib.sha1(b"<p>").digest())
    records.append(record(b"response", b"<urn:a>", http, b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha1:" + digest))
    records.append(record(b"revisit", b"<urn:b>", b"", b"WARC-Payload-Digest: sha1:" + digest))
    want += [("response", "<urn:a>", 3), ("revisit", "<urn:b>", None)]
    (tmp_path / "plain").mkdir()
    (tmp_path / "zip").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(b"".join(records))
    (tmp_path / "plain/b.warc").write_bytes(b"".join(records[:3]))
    (tmp_path / "zip/a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    found = warc.read_warc(spark, f"file://{tmp_path}/plain").collect()
    starts = np.cumsum([0, *map(len, records)])[:-1].tolist()
    rows = sorted((r.start, r.record_type, r.id, r.payload_bytes) for r in found if r.file.endswith("a.warc"))
    assert rows == [(s, *w) for s, w in zip(starts, want)]
    assert sorted((r.record_type, r.id, r.payload_bytes) for r in found if r.file.endswith("b.warc")) == sorted(want[:3])
    assert [r.verified for r in found if r.id == "<urn:a>"] == [True]
    packed = warc.read_warc(spark, f"file://{tmp_path}/zip").collect()
    assert sorted(map(str, ((r.start, r.record_type, r.id, r.payload_bytes) for r in packed))) == sorted(map(str, rows))


def test_warc_broken_chains(spark, tmp_path):
    one = record(b"response", b"<urn:record:1>", b"ab")
    for i, data in enumerate((one + b"x", b"x" + one, one[:-1], one * 3 + one[:40])):
        (tmp_path / str(i)).mkdir()
        (tmp_path / f"{i}/a.warc").write_bytes(data)
        with pytest.raises(ValueError, match="chain"):
            warc.read_warc(spark, f"file://{tmp_path}/{i}")


def test_decontamination_tolerates_substitutions(spark, docs, empty):
    rng = random.Random(6)
    items = [(i, sentence(rng, "en", 25)) for i in range(20)] + [(20, None), (21, ""), (22, "two words")]
    texts = []
    for i, t in items[:20]:
        w = t.split()
        for k in range(3, len(w), 7):
            w[k] = "other"
        texts.append((1000 + i, f"{sentence(rng, 'fr', 30)} {' '.join(w).upper()}. {sentence(rng, 'fr', 30)}"))
    texts += [(2000, items[0][1] + " and " + items[1][1]), (2001, " ".join(items[2][1].split()[:12])), (2002, " ".join(items[3][1].split()[:6]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(extra, bench).collect()}
    assert got == {(1000 + i, i) for i in range(20)} | {(2000, 0), (2000, 1), (2001, 2)}
    kept = {r.doc_id for r in decontaminate.clean(extra, bench).collect()}
    assert kept == {r.doc_id for r in extra.collect()} - {i for i, _ in got}
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(empty, bench).columns == empty.columns


def test_decontamination_of_ties_does_not_depend_on_the_batch():
    """A passage twice in one text: the first is given, wherever the text stands in its batch."""
    rng = random.Random(9)
    item = sentence(rng, "en", 12)
    block = decontaminate.Block([1], [item.encode()])
    text = f"{sentence(rng, 'fr', 7)} {item} {sentence(rng, 'fr', 9)} {item}".encode()
    for before in range(40):
        other = [sentence(rng, "fr", rng.randint(1, 30)).encode() for _ in range(before)]
        assert block.overlaps([*other, text]) == [(before, 0, 7, 0, 12, 12)]


def test_seed_masks_are_spaced():
    assert all("0" in m and m[0] == m[-1] == "1" for m in decontaminate.MASKS)


def test_decontamination_in_blocks(spark):
    rng = random.Random(8)
    bench = spark.createDataFrame([(i, sentence(rng, "en", 20)) for i in range(10)], "item_id long, text string")
    found = [b.ids for b in decontaminate.blocks(bench, "item_id", "text", 45)]
    assert sorted(i for b in found for i in b) == list(range(10)) and max(map(len, found)) <= 2


def test_decontamination_by_several_blocks_gives_the_same(spark, docs):
    rng = random.Random(16)
    items = [(i, sentence(rng, "en", 20)) for i in range(12)] + [(12, None), (13, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(3000 + i, f"{sentence(rng, 'fr', 8)} {items[i][1]} {sentence(rng, 'de', 5)} {items[(i * 5 + 1) % 12][1]}") for i in range(12)]
    texts += [(None, items[3][1]), (None, "nothing of it"), (3000, "another row of that key"), (4000, " ".join(items[4][1].split()[:5]))]
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    for query in (decontaminate.overlaps, decontaminate.clean):
        one, many = (sorted(map(str, query(extra, bench, block_words=n).collect())) for n in (10**6, 45))
        assert one == many and one


def test_best_stretch_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(100):
        same = rng.random(12) < 0.7
        score = lambda a, b: sum(1 if x else -decontaminate.MISS for x in same[a:b])
        a, b = decontaminate.stretch(same)
        assert score(a, b) == max(score(i, j) for i in range(13) for j in range(i, 13))

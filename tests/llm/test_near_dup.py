import random

import pytest

from corpusloom.llm import graph, near_dup
from corpusloom.llm.queries import op9_near_duplicates
from tests.conftest import SF


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def check(rows, texts, k, percent):
    want, sizes = components(texts, k, percent)
    got = {r["doc_id"]: r for r in rows}
    assert set(got) == set(texts)
    for i in texts:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (sizes[i], want[i], want[i] == i), i


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op9_near_duplicates(spark, SF).collect(), texts, 2, 80)


def family(rng, n, size, edits, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(size)] = rng.choice(vocabulary)
        yield " ".join(w)


def test_families_and_edges(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [*family(rng, 90, 120, 14, vocabulary), *family(rng, 40, 60, 4, vocabulary), *("the of " + " ".join(rng.choices(vocabulary, k=9)) for _ in range(120))]
    texts += ["", "  \n ", None, "one", "ONE", "one two", "One  TWO", texts[0], texts[0].upper(), "é É", "x " * 3000]
    rng.shuffle(texts)
    data = {i: t for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in data.items()], "doc_id long, text string, cid string, node int")
    check(near_dup.near_duplicates(df, words=2, percent=80).collect(), data, 2, 80)


@pytest.mark.parametrize("depth, block", [(4, 1024), (1, 1024), (2, 7)])
def test_small_nodes_off(spark, monkeypatch, depth, block):
    """With nodes of two at most, families go through their pivots, and what doesn't branch further is compared in blocks."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "DEPTH", depth)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = dict(enumerate([*family(rng, 50, 100, 12, vocabulary), *family(rng, 30, 100, 20, vocabulary), *("the same start of all " + " ".join(rng.choices(vocabulary, k=12)) for _ in range(40))]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(near_dup.near_duplicates(df, words=2, percent=80).collect(), texts, 2, 80)


def test_recall_at_the_threshold(spark):
    """All of 1,500 pairs with similarities from 0.8 to 0.85 are found."""
    rng = random.Random(8)
    texts, want = {}, 0
    while want < 1500:
        base = [f"{want}x{i}" for i in range(60)]
        copy = list(base)
        for at in rng.sample(range(2, 58, 4), rng.choice((3, 3, 2))):
            copy[at] = f"{want}y{at}"
        a, b = shingles(" ".join(base), 2), shingles(" ".join(copy), 2)
        if 0.8 <= len(a & b) / len(a | b) <= 0.9:
            texts[2 * want], texts[2 * want + 1] = " ".join(base), " ".join(copy)
            want += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, words=2, percent=80).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(want)) == want


def test_smallest_linked_sets(spark):
    """Four shingles of five are 80 %; three of four aren't."""
    for k in (2, 5):
        pairs = [[f"p{i}x{j}" for j in range(k + 3)] for i in range(20)]
        texts = dict(enumerate(" ".join(w) for p in pairs for w in (p, [*p, "more"])))
        texts |= {100: " ".join(f"q{j}" for j in range(k + 2)), 101: " ".join(f"q{j}" for j in range(k + 3))}
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        check(near_dup.near_duplicates(df, words=k, percent=80).collect(), texts, k, 80)


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "z")]
    got = sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).na.fill(-1).collect())
    assert got == [(-1, 1, -1, True), (-1, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copy_without_id(spark):
    """Its links count, and so do those that run through it."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (None, " ".join(words + ["x1", "x2", "x3", "x4", "x5", "x6"])), (2, " ".join(words + [f"x{i}" for i in range(1, 13)])), (None, "other words alone")]
    got = sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).na.fill(-1).collect())
    assert got == [(-1, 2, -1, True), (-1, 45, 1, False), (1, 39, 1, True), (2, 51, 1, False)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in root if any(x in e for e in edges if e[0] != e[1])}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in graph.connected_components(df).collect()} == want


def test_words_that_a_polynomial_confuses(spark):
    """Words of a and b by the parity of their place's bits, and the same with a and b swapped, are different words."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = {1: f"{word} q r s", 2: f"{other} q r s", 3: f"{word} q {other} q"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(near_dup.near_duplicates(df, words=2, percent=80).collect(), texts, 2, 80)


def test_branches_of_a_node_differ(spark, monkeypatch):
    """No node gets a class twice, and what a level is made of is made once, not for its counts and again for its rows."""
    rows, plans = [], []

    def watched(df):
        if {"node", "cid"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            rows.append(out := written(df))
            return out
        return written(df)

    written = near_dup.written
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "written", watched)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = dict(enumerate(" ".join([*(f"f{i % 30}x{j}" for j in range(25)), *rng.choices(vocabulary, k=15)]) for i in range(600)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(near_dup.near_duplicates(df, words=2, percent=80).collect(), texts, 2, 80)
    assert len(rows) > 6
    assert all(df.groupBy("node", "cid").count().where("count > 1").isEmpty() for df in rows)
    assert all(p.count("Generate explode") <= 1 for p in plans)

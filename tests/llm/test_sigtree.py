import random

import numpy as np
import pytest

from corpusloom.llm import near_dup, sigtree
from corpusloom.llm.common import shingle_sets
from corpusloom.llm.queries import op12_jaccard_join
from tests.conftest import SF
from tests.llm.test_near_dup import components, family, shingles


def check(rows, texts, k, percent):
    want, sizes = components(texts, k, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert set(got) == set(texts)
    for i in texts:
        assert got[i] == (sizes[i], want[i]), i


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op12_jaccard_join(spark, SF).collect(), texts, 5, 80)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = [*family(rng, 90, 120, 14, vocabulary), *family(rng, 40, 60, 4, vocabulary), *(passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(2, 30))) for _ in range(150))]
    texts += ["", "  \n ", None, "one", "ONE", "one two", "One  TWO", texts[0], texts[0].upper(), "é É", "x " * 3000, "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("leaf, common, block, wide", [(64, 4, 1024, 512), (4, 4, 1024, 20), (2, 2, 7, 90), (64, 1 << 30, 1024, 0)])
def test_families_and_edges(spark, monkeypatch, leaf, common, block, wide):
    """Also with small leaves, so that most groups go through trees and blocks, and in another order of shingles."""
    monkeypatch.setattr(sigtree, "LEAF", leaf)
    monkeypatch.setattr(sigtree, "COMMON", common)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(sigtree, "WIDE", wide)
    data = corpus(random.Random(leaf))
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in data.items()], "doc_id long, text string, cid string, grp int").repartition(3)
    check(sigtree.jaccard_components(df).collect(), data, 5, 80)


def test_other_widths(spark):
    data = corpus(random.Random(9))
    df = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    check(sigtree.jaccard_components(df, words=2, percent=70).collect(), data, 2, 70)


def test_traversal_loses_nothing(monkeypatch):
    """Every linked pair is left by the trees, and most others are pruned."""
    monkeypatch.setattr(sigtree, "LEAF", 4)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    sets = shingle_sets([t for _ in range(40) for t in family(rng, 5, rng.randrange(20, 200), 5, vocabulary)], 2)
    sizes = np.array([len(s) for s in sets])
    tree = sigtree.Tree(np.stack([sigtree.token_bits(s) for s in sets]), sizes)
    left = sigtree.dual_traversal(tree, tree, 80)
    linked = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert linked.sum() > 400 and (left | ~linked).all() and left.sum() < 2 * linked.sum()


def test_wide_bitmaps():
    """Linked sets of any sizes pass, sets that share half of their tokens don't."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        base = rng.integers(0, 1 << 63, int(rng.integers(600, 3000))).astype(np.uint64)
        more = rng.integers(0, 1 << 63, int(rng.integers(0, len(base) // 8))).astype(np.uint64)
        x, y = np.unique(base), np.unique(np.concatenate([base[int(rng.integers(0, len(base) // 20)) :], more]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert sigtree.widely_alike(sigtree.wide_bits(x), len(x), sigtree.wide_bits(y), len(y), 80)
        z = np.unique(np.concatenate([base[: len(base) // 2], rng.integers(0, 1 << 63, len(base) // 2).astype(np.uint64)]))
        assert not sigtree.widely_alike(sigtree.wide_bits(x), len(x), sigtree.wide_bits(z), len(z), 80)


def test_prefixes_meet():
    """Linked sets share one of their first shingles, whatever is ranked last."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(4, 60))
        base = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        other = np.unique(np.concatenate([base[int(rng.integers(0, max(1, n // 9))) :], rng.integers(0, 1 << 60, int(rng.integers(0, n // 9 + 2))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 80 * (len(base) + len(other) - both):
            ranked = np.sort(rng.choice(base, len(base) // 2, replace=False))
            rank = rng.permutation(len(ranked))
            assert len(np.intersect1d(sigtree.prefix(base, ranked, rank, 80), sigtree.prefix(other, ranked, rank, 80)))


def test_odd_ids_and_nothing(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "z")]
    got = sorted(tuple(r) for r in sigtree.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).na.fill(-1).collect())
    assert got == [(-1, 1, -1), (-1, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert sigtree.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_differ():
    """Words of a and b that a polynomial hash modulo a power of two can't tell apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    x, y = shingle_sets([f"{word} q r s", f"{other} q r s"], 2)
    assert len(x) == len(y) == 3 and len(np.intersect1d(x, y)) == 2
    want = [len(shingles(t, 2)) for t in (f"{word} q {other} q", "", "one")]
    assert [len(s) for s in shingle_sets([f"{word} q {other} q", "", "one"], 2)] == want

import numpy as np

from corpusloom.llm import ann
from corpusloom.llm.queries import op3_nearest_vectors
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, every, k):
    good = {}
    for i, e in rows:
        if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            good[i] = np.array(e, np.float32).astype(np.float64)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        score = ann.cosine(np.broadcast_to(good[q], x.shape), x)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = exact(rows, 50, 5), by_query(op3_nearest_vectors(spark, SF).collect())
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 16))
    x = centers[rng.integers(0, 12, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    rows = [(i, [float(np.float32(v)) for v in e]) for i, e in enumerate(x)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    want, got = exact(rows, 50, 5), by_query(ann.nearest(df, leaf=20, least=600, factor=0.0).collect())
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got.get(q, [])}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (50, [0.0, 3.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)
    got = by_query(ann.nearest(df).collect())
    assert set(got) == {0, 50}
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 0.0), (50, 0.0), (4, -1.0)]
    assert got[50][0] == (3, 1.0) and len(got[50]) == 5
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_equal_vectors(spark):
    df = spark.range(300).selectExpr("id as vec_id", "array(cast(1 as float), cast(2 as float)) as embedding", "0 as label")
    got = by_query(ann.nearest(df).collect())
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[250]] == [0, 1, 2, 3, 4]


def test_all_ties_are_measured(spark):
    """Different vectors, all at the same angle to the query: the smallest ids win."""
    rows = [(0, [1.0] + [0.0] * 63)] + [(i, [0.0] * (1 + i % 60) + [float(i)] + [0.0] * (62 - i % 60)) for i in range(1, 300)]
    got = by_query(ann.nearest(spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)).collect())
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5]


def test_one_odd_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3 if i == 77 else 8).tolist(), 0) for i in range(200)]
    got = by_query(ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert set(got) == {0, 50, 100, 150} and all(len(v) == 5 for v in got.values()) and all(j != 77 for v in got.values() for j, _ in v)


def test_queries_of_a_leaf_are_split(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist(), 0) for i in range(300)], SCHEMA)
    want = by_query(ann.nearest(df, every=5).collect())
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "BLOCK", 40)
    assert by_query(ann.nearest(df, every=5).collect()) == want


def test_the_queue_prunes(spark):
    """Clustered vectors: under a fifth of the rows are ranked, with a recall of 0.9."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 64))[rng.integers(0, 60, 40_000)] + 0.5 * rng.standard_normal((40_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest(x[rng.choice(len(x), 8000, replace=False)], ann.TREES, 60)
    leaves = np.stack([forest.leaf_of(x, t) for t in range(ann.TREES)])
    sizes = np.bincount(leaves.ravel(), minlength=forest.leaves)
    hits = ranked = 0
    for q in range(0, 40_000, 800):
        near = x @ x[q]
        near[q] = -9
        found = forest.search(x[q], sizes, int(ann.FACTOR * len(x) ** ann.POWER), ann.LEAST, forest.reach(x[q : q + 1], 5)[0])
        rows = np.isin(leaves, found).any(axis=0)
        hits += rows[np.argsort(-near)[:5]].sum()
        ranked += rows.sum()
    assert hits >= 0.9 * 5 * 50 and ranked < 50 * 40_000 / 5

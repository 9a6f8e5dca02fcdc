import re

from corpusloom.llm import mixing
from corpusloom.llm.queries import op2_mix_sources
from tests.conftest import SF


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The rounds of the contract: cut at the cap, share the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left, weight = total - sum(full.values()), sum(w[s] for s in open_)
        t = {s: left * w[s] / weight for s in open_}
        over = [s for s in open_ if t[s] > most * sizes[s]]
        if not over:
            return full | t
        full |= {s: most * sizes[s] for s in over}


def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    sizes = {}
    for i, r in docs.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[i]
    want = targets(sizes)
    rows = op2_mix_sources(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    taken = {}
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_mix_sources(spark, SF).collect()))


def test_edges(spark):
    schema = "doc_id long, source string, size long, target string, extra int"
    rows = [(1, "a", 10, "x", 1), (1, "a", 10, "x", 1), (2, None, 5, "x", 1), (None, "b", 7, "x", 1), (3, "b", None, "x", 1), (4, "z", 0, "x", 1)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * 32) <= 4
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0


def test_a_large_source_is_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    df = spark.range(500).selectExpr("id as doc_id", "case when id < 400 then 'hot' else 'cold' end as source", "id % 13 as size")
    rows = mixing.mix(df).collect()
    for s in ("hot", "cold"):
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 1e-9)


def test_documents(spark):
    rows = [(i, "ab"[i % 2], f" w{i}  x\ty " * (i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df.withColumn("size", mixing.word_count("text"))).collect()}
    texts = {r[0]: r[2] for r in rows}
    got = {}
    for r in out.collect():
        assert texts[r["doc_id"]].startswith(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {i: n for i, n in taken.items() if n}

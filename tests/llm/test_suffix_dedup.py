import hashlib
import random
from collections import Counter

import pytest

from corpusloom.llm import suffix_dedup
from corpusloom.llm.queries import op5_suffix_dedup
from tests.conftest import SF


def brute_force(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        yield sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept


def check(rows, texts, length):
    got = {r["doc_id"]: r for r in rows}
    want = brute_force([(t or "").encode() for t in texts.values()], length)
    for i, (removed, spans, kept) in zip(texts, want, strict=True):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len((texts[i] or "").encode()), removed, spans, hashlib.sha256(kept).hexdigest()), i


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op5_suffix_dedup(spark, SF).collect(), texts, 200)


@pytest.mark.parametrize("hot, contexts", [(2_000, 2_000), (2_000, 3), (2, 2_000)])
def test_small_windows(spark, monkeypatch, hot, contexts):
    """Short windows over a small alphabet: many overlaps, periodic texts, edges of matches."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 7 * contexts)
    rng = random.Random(hot)
    word = lambda n: "".join(rng.choices("abé", k=n))
    passages = [word(rng.randrange(10, 60)) for _ in range(6)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.4 else word(12) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts += [None, "", "ab" * 80, "a" * 100, texts[0], "é" * 30, passages[0][:19]]
    data = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in data.items()], "doc_id long, text string, rid int, spans int")
    check(suffix_dedup.suffix_dedup(df, length=20, gram=8, batches=5, hot=hot).collect(), data, 20)


def test_long_text_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    rng = random.Random(9)
    shared = "".join(rng.choices("abcdefgh", k=400))
    data = {0: "x" + shared + "".join(rng.choices("abcdefgh", k=300)), 1: "".join(rng.choices("abcdefgh", k=77)) + shared}
    check(suffix_dedup.suffix_dedup(spark.createDataFrame(list(data.items()), "doc_id long, text string"), length=50, gram=20).collect(), data, 50)


def test_repeats_nothing_and_columns(spark):
    long = "".join(random.Random(1).choices("abcdefghij ", k=500))
    rows = [(1, long, "s", 7, 1, [1]), (1, long, "s", 7, None, None), (None, "é" + long[:300], "t", 2**60 + 1, 2, [2]), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rid long, spans int, `k 0` array<int>")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted((r["source"] or "", r["rid"] or 0, r["spans"] or 0, r["k 0"] or []) for r in out.collect()) == [("", 0, 0, []), ("s", 7, 0, []), ("s", 7, 1, [1]), ("t", 2**60 + 1, 2, [2])]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["text"] is not None) == [(0, "é"), (1, ""), (1, "")]
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], df.schema)).count() == 0


def test_batches_one_by_one(spark):
    """An index that takes in batches, over four levels, finds what one run over all of them finds."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdef", k=n))
    passages = [word(60) for _ in range(5)]
    df = spark.createDataFrame([(i, word(30) + rng.choice(passages) + word(30)) for i in range(70)], "rid long, text string")
    index = suffix_dedup.SuffixIndex(50, 20)
    for b in range(7):
        index.add_batch(df.where(f"rid % 7 = {b}"))
        assert [n for n, _ in index.levels] == [2**k for k in (2, 1, 0) if (b + 1) >> k & 1]
    plain = lambda x: sorted((r["rid"], sorted(map(tuple, r["spans"]))) for r in x.collect())
    found = plain(index.repeated_spans())
    assert found and found == plain(suffix_dedup.repeated_spans(df, 50, 20))

"""Token counts and packing against the tokenizer library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing, token_count
from corpusloom.llm.wordpieces import merge_table, merged_counts, vocabulary_path
from tests.conftest import SF

ODD = ["", "<|endoftext|> a", "a<|startoftext|>b<|endoftext|>", "ΣΑΣ ΟΔΟΣ", "İstanbul", "x\x1cy \x1d!\x1e!", "½ ² Ⅷ 一二", "don't I'LL we've '’s", "é é", " a\u0085b\xa0c", "日本語", "🙂👍🏽", "a" * 3000, "'s't're", "١٢٣ 123", "a_b__c--d", "Ünï \t\n x", "\x00\x7f", "aaa aaaa aaaaaaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def docs(spark, texts, extra=False):
    rows = [(i, t) + (("x", 1) if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + (", n_tokens string, rank int" if extra else ""))


def test_counts(spark, library):
    texts = [*ODD, None, ODD[1], ODD[1]]
    got = {r["doc_id"]: r for r in token_count.token_counts(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(ids(library, t)), t
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 2048) and got[i]["rank"] == 1
    assert token_count.token_counts(docs(spark, [])).count() == 0


def test_code_points_newer_than_pythons(spark, library):
    """What Python's Unicode data don't know goes through the library's own rules."""
    rng = random.Random(2)
    odd = [chr(c) for c in (0xA7CB, 0xA7DC, 0xA7DA, 0x10D50, 0x10D70, 0x1C89, 0x16EA0, 0x378, 0x301, 0x331, 0x2000)] + list("aH İΣ'7,")
    texts = ["".join(rng.choices(odd, k=rng.randrange(1, 14))) for _ in range(800)]
    df = docs(spark, texts)
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(df).collect()} == {i: len(ids(library, t)) for i, t in enumerate(texts)}
    check_packing(library, packing.packed_documents(df).collect(), dict(enumerate(texts)))


def test_a_full_memory_changes_nothing(library, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcde", k=rng.randrange(1, 6))) for _ in range(40)) for _ in range(60)]
    want = [ids(library, t) for t in texts]
    monkeypatch.setattr(packing, "MEMO_WORDS", 5)
    monkeypatch.setattr("corpusloom.llm.wordpieces.MEMO_WORDS", 5)
    encode, counts = packing.PartIds(vocabulary_path()).of, token_count.counter(vocabulary_path())
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == want
    assert [n for i in range(0, 60, 7) for n in counts.values(texts[i : i + 7])] == [len(w) for w in want]


def test_merging_by_words(library):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randrange(1, 30))) for _ in range(500)]
    assert merged_counts(words, merge_table(vocabulary_path())).tolist() == [len(ids(library, w)) for w in words]


def check_packing(library, rows, texts):
    places = {}
    for r in rows:
        want = (ids(library, texts[r["doc_id"]]) + [0])[r["start"] : r["start"] + r["length"]]
        assert len(want) == r["length"] and r["start"] == 2048 * r["piece"]
        assert zlib.crc32(np.array(want, "<u4").tobytes()) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


def test_packing(spark, library):
    rng = random.Random(5)
    texts = [*ODD, None, *("word " * rng.randrange(0, 5000) for _ in range(60))]
    rows = packing.packed_documents(docs(spark, texts, extra=True)).collect()
    n = check_packing(library, rows, dict(enumerate(texts)))
    total = sum(len(ids(library, t)) + 1 for t in texts)
    assert sum(r["length"] for r in rows) == total and n <= -(-total // 2048) + 2
    assert packing.packed_documents(docs(spark, [])).count() == 0


def test_repeated_rows_get_places_of_their_own(spark, library):
    df = docs(spark, ["same text here"] * 3).selectExpr("cast(null as long) doc_id", "text")
    rows = packing.packed_documents(df).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def brute_force(lengths, capacity):
    """The fewest bins, by trying all ways."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {bins[j]: j for j in range(len(bins)) if bins[j] + lengths[i] <= capacity}.values():
            place(i + 1, (*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]))
        place(i + 1, (*bins, lengths[i]))

    lengths = sorted(lengths, reverse=True)
    place(0, ())
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(7)
    for _ in range(150):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        counts = {w: lengths.count(w) for w in set(lengths)}
        fixed, left = packing.reduced(counts, 20)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert all(sum(w * t for w, t in c) <= 20 for c, _ in fixed)
        assert sum(n for _, n in fixed) + (brute_force(rest, 20) if rest else 0) == brute_force(lengths, 20), lengths
        bins = packing.packed_lengths(counts, 20)
        packed = sorted(w for c, n in bins for w, t in c for _ in range(t * n))
        assert packed == sorted(lengths)


def test_query(spark, library):
    from corpusloom.llm.queries import op1_token_count

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op1_token_count(spark, SF).collect():
        assert r["n_tokens"] == len(ids(library, texts[r["doc_id"]]))

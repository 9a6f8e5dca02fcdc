"""The stages, each against a brute-force version on what came before."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm.wordpieces import vocabulary_path
from tests.conftest import SF

from .test_mixing import targets
from .test_near_dup import components
from .test_suffix_dedup import brute_force


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [d.collect() for d in out], [d.columns for d in out]


def test_columns(steps):
    assert all(c == steps[1][0] for c in steps[1][:-1])


def test_language(steps):
    before, after = steps[0][0], steps[0][1]
    kept = {r["doc_id"] for r in after}
    assert all(r["doc_id"] in kept for r in before if re.search(r"[^\W\d_]{3}", r["text"] or ""))


def test_language_rejects(spark):
    """Ambiguous and letterless documents go; others get the language that is predicted, or keep theirs."""
    words = {"en": "the cat and the dog saw this house ", "de": "der Hund und die Katze sehen das Haus "}
    rows = [(i, words["en" if i % 2 else "de"] * 3, "en" if i % 2 else "de", "s") for i in range(80)]
    rows += [(100, "12 34 !?", None, "s"), (101, None, "en", "s"), (102, words["en"] * 2 + "x", None, "s"), (103, words["de"] * 2, "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, df, SF).collect()}
    assert 100 not in got and 101 not in got and got[102] == "en" and got[103] == "fr" and len(got) == 82
    from corpusloom.llm import langid

    close = langid.identify(df, langid.learned(df)).where("ambiguous").select("doc_id").collect()
    assert not {r["doc_id"] for r in close} & set(got)


ODD_COLUMNS = "doc_id long, text string, lang string, source string, found int, kept_id int, _id int, spans array<int>, rid string, size int, taken int, words string, _key double, lang_pred string, length int, `a b` int"


def odd_rows():
    long = " ".join(f"word{i} of the text" for i in range(300))
    for i, (doc_id, text, lang, source) in enumerate([(1, long, "en", "a"), (1, long, "en", "a"), (2, None, None, None), (None, "some other text without an id", None, "b"), (3, "", "de", "b"), (4, "ein ganz anderer Text steht hier", "de", None), (5, long + " and an end", "en", "b")]):
        yield doc_id, text, lang, source, i, i, None, [i], None, i, i, "w", 0.5, None, i, i


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, name, stage):
    """Nulls in any column, empty texts, repeated rows, clashing names and no rows at all."""
    df = spark.createDataFrame(list(odd_rows()), ODD_COLUMNS)
    out, none = stage(spark, df, SF), stage(spark, df.where("false"), SF)
    rows = out.collect()
    assert none.columns == out.columns and none.count() == 0
    if name == "pack":
        assert len(rows) >= 7 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
        return
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    seen = sorted((r["doc_id"] or 0) for r in rows)
    if name == "near_duplicates":
        assert seen == [0, 1, 1, 2, 3, 4]
    elif name == "repeated_passages":
        assert seen == [0, 4, 5] and {r["text"] for r in rows if r["doc_id"] == 5} == {" and an end"}
    elif name == "mix":
        assert set(seen) <= {0, 1, 4, 5} and len(rows) >= 3
    by_found = {r[4]: r for r in odd_rows()}
    assert all((r["spans"], r["a b"], r["_key"]) == ([r["found"]], r["found"], 0.5) and by_found[r["found"]][0] == r["doc_id"] for r in rows)


def test_near_duplicates(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[0][1]}
    want, _ = components(texts, 5, 80)
    assert sorted(r["doc_id"] for r in steps[0][2]) == sorted({want[i] for i in texts})


def test_passages(steps):
    before = steps[0][2]
    kept = [k.decode("utf-8", "ignore") for _, _, k in brute_force([r["text"].encode() for r in before], 200)]
    want = sorted((r["doc_id"], k) for r, k in zip(before, kept, strict=True) if k)
    assert sorted((r["doc_id"], r["text"]) for r in steps[0][3]) == want


def test_mix(steps):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in steps[0][3]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    for r in steps[0][4]:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    want = targets(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in sizes)


def test_pack(steps):
    library = Tokenizer.from_file(vocabulary_path())
    total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in steps[0][4])
    rows = steps[0][5]
    assert sum(r["length"] for r in rows) == total
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():  # no gaps, no more than fits
        ends = [0]
        for offset, length in sorted(found):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    pieces = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for r in steps[0][4]:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)]
    assert pieces == sorted(want)

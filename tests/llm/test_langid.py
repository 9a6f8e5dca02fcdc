import zlib

import numpy as np

from corpusloom.llm import langid
from corpusloom.llm.queries import op8_language_id
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string"


def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    right = held = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["held_out"]:
            held += 1
            right += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert right >= 0.97 * held


def test_edges(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der Hund und die Katze " * 3, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 34 !?", "en"), (102, "", None), (None, "the dog", None), (103, "the cat and a dog", None), (103, "the cat and a dog", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", lang_pred string")
    got = langid.language_of(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[100]["lang_pred"] == by[101]["lang_pred"] == by[102]["lang_pred"] == "und"
    assert by[103]["lang_pred"] == by[None]["lang_pred"] == "en" and not by[None]["held_out"]
    nothing = langid.language_of(spark.createDataFrame([(1, "text", None)], SCHEMA)).first()
    assert nothing["lang_pred"] == "und" and nothing["score"] == 0
    assert langid.language_of(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_are_apart():
    for n in (1, 2, 4, 5, 12, 40):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(c) for c in code}) == n
        if n > 5:
            assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= code.shape[1] // 5


def test_decoding_corrects_a_bit():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.eye(langid.DIM, code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    x = np.zeros((1, langid.DIM))
    x[0, : code.shape[1]] = 3.0 * code[2]
    x[0, 0] *= -1
    assert model.decode(x)[0][0] == 2


def test_numerals_are_no_letters(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der Hund und die Katze " * 3, "en" if i % 2 else "de") for i in range(60)] + [(100 + i, t, None) for i, t in enumerate(["½ ² ①", "Ⅷ", "_ 1", "ª", "ж"])]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100] == got[101] == got[102] == "und" and got[103] != "und" and got[104] != "und"

"""Rules on small texts, each with a twin that must not fire."""

import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import all_matches, line_number, quote_around, split_lines, strip
from corpusloom.operators import consistency, context, entities, links, markdown, readability, rights, similarity, verdicts
from corpusloom.operators.lines import lines, sticky_state, without_fences
from corpusloom.plans import oracles, queries
from corpusloom.sources import findings_json


def files(spark, *rows):
    return spark.createDataFrame([(u, p, k, t) for u, p, k, t in rows], "unit_id string, relative_path string, kind string, text string")


def readme(spark, text):
    return lines(files(spark, ("u", "README.md", "readme", text)))


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lines(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc d\n",), ("",), ("\n\n",), (None,)], "t string")
    assert [r[0] for r in df.select(split_lines(F.col("t"))).collect()] == [["a", "b", "c", "d"], [], ["", ""], None]


def test_places(spark):
    df = spark.createDataFrame([("жx\nyy  foo bar foo",)], "t string").select("t", F.explode(all_matches(F.col("t"), "foo")).alias("m"))
    x = df.select("m.start", line_number(F.col("t"), F.col("m.start")).alias("n"), quote_around(F.col("t"), F.col("m.start"), F.col("m.start") + 3).alias("q"))
    assert found(x, "start", "n", "q") == [(7, 2, "yy foo bar foo"), (15, 2, "yy foo bar foo")]


def test_fences_and_states(spark):
    x = readme(spark, "a\n```\ncode\n```\n## Task 1\nb\n## Theory\nc")
    assert [r["line"] for r in without_fences(x).orderBy("line_no").collect()] == ["a", "## Task 1", "b", "## Theory", "c"]
    s = sticky_state(x, r"^## Task", r"^## Theory")
    assert [r["line_no"] for r in s.where("in_task").orderBy("line_no").collect()] == [5, 6]


def test_entities(spark):
    f = files(spark, ("u", "README.md", "readme", "See https://a.example/x. **https://b.example/**\n![pic](img/a.png \"t\") http:// none\nPython 3.11 since 2024-05-01, version 7"))
    got = found(entities.entities(f), "entity_type", "value", "line_start")
    assert ("link", "https://a.example/x", 1) in got and ("link", "https://b.example/", 1) in got
    assert ("image", "img/a.png", 2) in got and ("version", "Python 3.11", 3) in got and ("date", "2024-05-01", 3) in got and ("technology", "Python", 3) in got
    assert not any(t == "link" and "none" in v for t, v, _ in got) and not any(v == "version 7" for _, v, _ in got)


def test_broken_urls(spark):
    x = readme(spark, "http:/\\a.b/c\nhttps:/x.y/z\nhttps//x.y\nhttps://fine.example/a b\nhttps:// a.b")
    assert found(links.broken_urls(x), "line_start", F.element_at("extra", "pattern")) == [(1, "slash_backslash"), (2, "single_slash"), (3, "missing_colon"), (5, "space_after_scheme")]


def test_link_ladder(spark):
    urls = [("https://a.example/x", 404, None, None), ("https://b.example/x", 503, None, None), ("https://c.example/x", 200, "https://c.example/", None), ("https://opros.so/x", 200, "https://oprosso.ru/y", None), ("https://d.example/", 0, None, "redirect loop"), ("http://10.0.0.1/x", 404, None, None), ("https://www.e.example/x", 200, "https://e.example/x", None)]
    snapshot = spark.createDataFrame(urls, "url string, status int, final_url string, error string")
    x = snapshot.select(F.lit("u").alias("unit_id"), F.lit("f").alias("file_path"), F.lit(1).alias("line_start"), F.col("url").alias("value"))
    x = x.union(spark.createDataFrame([("u", "f", 1, "https://new.example/")], x.schema))
    got = dict(found(links.link_status(x, snapshot), "quote", "issue_type"))
    assert got == {"https://a.example/x": "gone", "https://b.example/x": "transient", "https://c.example/x": "redirect_rot", "https://d.example/": "redirect_chain", "http://10.0.0.1/x": "policy", "https://new.example/": "no_snapshot"}


def test_missing_images(spark):
    images = spark.createDataFrame([("u", "docs/a.md", 1, "../img/x.png"), ("u", "docs/a.md", 2, "y.png"), ("u", "docs/a.md", 3, "../../z.png"), ("u", "docs/a.md", 4, "https://h.example/q.png")], "unit_id string, file_path string, line_start int, value string")
    paths = spark.createDataFrame([("u", "img/x.png")], "unit_id string, relative_path string")
    assert found(links.missing_images(images, paths), "line_start") == [(2,), (3,)]


def test_headings_and_chapters(spark):
    x = readme(spark, "# Chapter I\n## Intro\n## Chapter III\n## intro!\n## Chapter III\n## Intro")
    assert found(markdown.repeated_headings(x), "line_start", "issue_type") == [(4, "duplicate_anchor"), (4, "duplicate_heading"), (5, "duplicate_anchor"), (5, "duplicate_heading"), (6, "duplicate_anchor"), (6, "duplicate_heading")]
    assert found(markdown.chapter_order(x), "line_start") == [(3,)]


def test_numbered_lists(spark):
    assert found(markdown.numbered_lists(readme(spark, "1) a\n1) b\n1) c")), "line_start", "issue_type") == [(2, "repeated_numbered_list_items")]
    assert found(markdown.numbered_lists(readme(spark, "1. a\n2. b\n\n1. c")), "line_start", "issue_type") == [(4, "numbered_list_reset")]
    assert found(markdown.numbered_lists(readme(spark, "1. a\n3. b")), "line_start", "issue_type") == [(2, "numbered_list_out_of_order")]
    assert found(markdown.numbered_lists(readme(spark, "1. a\n1. b\n1. c\ntext\n5. d\n6. e")), "line_start") == []


def test_labels(spark):
    assert found(markdown.labels(readme(spark, "Output\n\n`5`\nExample: 1\nResult 12\nOutput of the program is long\nResult\nExample\nx")), "line_start") == [(1,), (5,), (8,)]


def test_readability(spark):
    x = readme(spark, "TODO later\nmethodology\n" + "a" * 261 + "\n" + "b" * 260)
    assert found(readability.placeholders(x), "line_start") == [(1,)]
    assert found(readability.long_lines(x), "line_no") == [(3,)]
    assert found(readability.editorial(readme(spark, "The COMANY\n```\nCOMANY\n```\nuse `x` and \"some text\"")), "line_start", "issue_type") == [(1, "typo"), (5, "quote_style")]


def test_languages(spark):
    f = files(spark, ("u", "a_RUS.md", "readme", "plain English text with more than forty letters in it"), ("u", "b_ENG.md", "readme", "plain English text with more than forty letters in it"), ("v", "c_rus.md", "readme", "short"))
    assert found(readability.language_mismatches(f), "file_path") == [("a_RUS.md",)]
    assert found(readability.language_coverage(f, ["RUS", "ENG", "UZ"]), "unit_id", "coverage_ratio") == [("u", 2 / 3), ("v", 1 / 3)]


def test_consistency(spark):
    assert found(consistency.sort_conflicts(readme(spark, "Sort ascending\nsorted asc or desc\nThe order is desc\n# next\nsort asc")), "line_start", "line_end") == [(1, 3)]
    assert found(consistency.word_definitions(readme(spark, "a word is any symbol\na word is a sequence")), "line_start") == [(1,)]
    assert found(consistency.field_variants(readme(spark, "Email\nE-mail\nemail")), "line_start") == [(3,)]
    assert found(consistency.field_variants(readme(spark, "Email\nemail")), "line_start") == []
    assert found(consistency.table_mismatches(readme(spark, "Fields: name, age\n| Name | City |")), "line_start") == [(2,)]
    assert found(consistency.table_mismatches(readme(spark, "Fields: name, city\n| Name | City |")), "line_start") == []
    assert found(consistency.length_conflicts(readme(spark, "functions of 20-30 lines\nmethods of 20 to 40 lines\n1-2 lines")), "line_start") == [(2,)]


def test_rights(spark):
    f = files(spark, ("u", "README.md", "readme", "text"), ("v", "README.md", "readme", "MIT License"), ("w", "LICENSE", "text", "x"))
    assert found(rights.units_without_license(f), "unit_id") == [("u",)]
    p = spark.createDataFrame([("MIT",), ("GPL-3.0-only",), (None,), ("LicenseRef-X",)], "s string")
    assert [r[0] for r in p.select(rights.license_policy(F.col("s"))).collect()] == ["allow", "deny", "review", "review"]
    d = files(spark, ("u", "README.md", "readme", "the dataset is here"), ("v", "README.md", "readme", "the dataset, license: CC"))
    assert found(rights.dataset_terms(d), "unit_id") == [("u",)]


def test_winnowing(spark):
    body = "def f(a):\n    return a + 1  # add one\n" * 4 + "\n".join(f"def g{i}(x): return x * {i}" for i in range(30))
    f = files(spark, ("a", "x.py", "text", body), ("b", "y.py", "text", body.replace("# add one", "# plus")), ("c", "z.py", "text", "\n".join(f"class K{i * 7}: pass" for i in range(60))), ("d", "w.py", "text", "# license: MIT\n" + body))
    docs = similarity.code_docs(f)
    got = found(similarity.similar_units(docs), "a", "b")
    assert got == [("a", "b"), ("a", "d"), ("b", "d")]
    assert found(rights.copied_code(similarity.code_matches(docs)), "unit_id", "quote") == [("a", "b"), ("a", "d"), ("b", "a"), ("b", "d")]


def test_long_numbered_lists(spark, tmp_path):
    """A page's items behind the 900th count, and the next page's lines don't get between them."""
    item = lambda x: f"<li><a href='#'>{x}</a></li>"
    long = "<h1>long</h1>" + "".join(item("" if i == 1000 else f"x{i}") for i in range(1, 1201))
    rows = [(3, "https://a.example/3", long), (4, "https://a.example/4", "<h1>short</h1>" + "".join(item(f"y{i}") for i in range(1, 7)))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = found(queries.numbered_list_blocks(spark, str(tmp_path)), "issue_type", "line_start", "quote")
    assert got == sorted([("repeated_numbered_list_items", 3002, "1) x2"), ("repeated_numbered_list_items", 4002, "1) x1002"), ("numbered_list_reset", 4004, "3. y4")])


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "Notes ###"), (2, "notes #")],
        [(1, "`a` b"), (2, "`a` B"), (3, "[a](u) b"), (4, "[a](u)  b"), (5, "a b")],
        [(1, "x" * 400), (2, "X" * 400), (3, "#1"), (4, "#1")],
        [(1, "½ cup"), (2, "cup"), (3, "a\xa0b"), (4, "ab"), (5, "a\n b"), (6, "İx"), (7, "ix"), (8, "ΑΣ"), (9, "ασ"), (10, "\n"), (11, "\t"), (12, "\xa0")],
        [(1, "ab"), (None, "ab"), (2, "ab"), (3, None), (4, "ab")],
        [(3_000_000, "ab"), (3_000_001, "ab")],
    ],
    ids=["closing", "markup", "long", "characters", "nulls", "numbers"],
)
def test_titles_stay_as_they_are(spark, tmp_path, rows):
    """A page's title isn't Markdown: nothing of it is markup, it may be long, and spaces and lower case are SQL's; a page's number may be large or missing."""
    rows = [(i, "https://a.example/", t and f"<h1>{t}</h1>") for i, t in rows]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    theirs = sorted(con.execute(oracles.ORACLE_SQL["duplicate_headings"]).fetchall())
    assert theirs and found(queries.duplicate_headings(spark, str(tmp_path)), "unit_id", "issue_type", "line_start", "quote", "first_line") == theirs


def test_anchors_keep_numbers(spark):
    """½ and ² are characters of a word, a circled letter is none."""
    assert found(markdown.repeated_headings(readme(spark, "# cup\n# ½ cup\n# ² cup\n# Ⓐ cup")), "line_start", "issue_type") == [(2, "duplicate_heading"), (3, "duplicate_heading"), (4, "duplicate_anchor"), (4, "duplicate_heading")]


def test_copied_document_classes(spark, tmp_path):
    """Every copy is in a row, also of a text that has no near copy."""
    spark.createDataFrame([(3, "same"), (1, "same"), (2, "other"), (7, "same"), (5, None), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.copied_document_classes(spark, str(tmp_path)), "doc_id", "class_id", "copies") == [(1, 1, 3), (2, 2, 1), (3, 1, 3), (7, 1, 3)]


def test_rolling_crc():
    """Every gram's checksum is zlib's, whatever its length in bytes."""
    rng = random.Random(3)
    for alphabet in ("abc ", "aé", "aжж日🙂"):
        for n in (0, 5, 30, 31, 200, 1500):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            for gram in (1, 7, 30):
                assert similarity.gram_crcs(text, gram).tolist() == [zlib.crc32(text[i : i + gram].encode()) for i in range(len(text) - gram + 1)]


def test_winnowed_among_is_a_filter():
    """With a bitmap of wanted grams, the wanted minima are those of the whole text, for either hash."""
    rng = random.Random(4)
    for kind in ("crc32", "md5"):
        part = "".join(rng.choice("abcdé ") for _ in range(120))
        text = "".join(rng.choice("abcdé ") for _ in range(700)) + part + "".join(rng.choice("abcd ") for _ in range(300))
        own, crcs = similarity.winnowed(part, 10, 4, kind)
        bits = np.zeros(1 << (similarity.BITS - 3), np.uint8)
        for c in crcs & ((1 << similarity.BITS) - 1):
            bits[c >> 3] |= 1 << (c & 7)
        whole, _ = similarity.winnowed(text, 10, 4, kind)
        some, _ = similarity.winnowed(text, 10, 4, kind, bits)
        assert set(own) & set(whole) == set(own) & set(some) and len(some) < 0.5 * len(whole) and len(set(own) & set(some)) > 30


def test_claim_noise(spark):
    """Each filter drops its line, and a twin of each stays."""
    rows = [
        ("See [here](https://a.example/b) for more", True), ("The standard [here](https://a.example/b) was set for all of its users in 2020", False),
        ("To run the latest release, install the tools", True), ("Some tools of the latest release install themselves", False),
        ("The project is built with the latest standard tools", True), ("The project was built in 2020 with standard tools", False), ("Files to turn in: the standard ones", True),
        ("You must use the standard", True), ("# Heading", True), ("| a | b |", True), ("", True), ("[Up](#top) of all", True), ("Leave your feedback", True), ("1. An option", True), ("The release was published", False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["noise"] for r in df.select("i", context.is_claim_noise(strip(F.col("t")), context.clean_claim(F.col("t"))).alias("noise")).collect()}
    assert got == {i: noise for i, (_, noise) in enumerate(rows)}


def test_fact_batches(spark):
    """README.md and README_RUS.md only, outside tasks, with definitions, in batches that end with their file."""
    fact = "The release of version 3 was published in 2020 by its team."
    text = "\n".join(["## Theory", fact, "Docker: a tool", "Docker: a tool of the kind that is standard", "## Task 1", fact, "## Theory", *[fact] * 5])
    rows = lines(files(spark, ("u", "b/README.md", "readme", text), ("u", "A/readme_rus.md", "readme", fact), ("u", "README_ENG.md", "readme", fact), ("v", "README.md", "text", "nothing at all")))
    got = [tuple(r) for r in context.fact_batches(rows, 3, 3).orderBy("batch").select("batch", "relative_path", "line_start", "line_end", "allowed_lines").collect()]
    assert got == [(0, "A/readme_rus.md", 1, 1, [1]), (1, "b/README.md", 2, 8, [2, 4, 8]), (2, "b/README.md", 9, 11, [9, 10, 11])]
    assert context.fact_batches(rows, 3, 3).where("batch = 1").first()["text"].split("\n")[0] == f"2: {fact}"


def test_gates(spark):
    """Each gate fails once, the first that does is told, and what passes all has none."""
    base = {"unit_id": "u", "checker_name": "spelling_wording_checker", "relative_path": "README.md", "line": 2, "quote": "teh", "issue_type": "Typo", "criterion": "readability", "verdict": "fail", "confidence": 0.9, "evidence": "wrong", "recommendation": "the"}
    own = {"checker_name": "curriculum_relevance_checker", "criterion": "correctness", "issue_type": "inappropriate_tool", "line": None}
    cases = [
        ({}, None), ({"confidence": 0.6}, "confidence"), ({"issue_type": "facts"}, "issue_type"), ({"issue_type": None}, "issue_type"), ({"evidence": " "}, "text"), ({"line": 9}, "line"), ({"quote": "the"}, "quote"), ({"confidence": None}, "confidence"),
        (own, None), (own | {"confidence": 0.64}, "confidence"), (own | {"confidence": 0.64, "issue_type": "other"}, None), (own | {"verdict": "pass"}, "verdict"), (own | {"criterion": "links"}, "criterion"), (own | {"evidence": "a Makefile"}, "tooling"),
        (own | {"evidence": "a Makefile in a Java project"}, None), (own | {"quote": "", "evidence": None, "recommendation": ""}, "text"),
        ({"checker_name": "model_rubric_checker", "confidence": 0.65}, "confidence"), ({"checker_name": "model_rubric_checker", "verdict": "unknown"}, "verdict"), ({"checker_name": "model_rubric_checker", "relative_path": None, "quote": None}, "place"), ({"checker_name": "model_rubric_checker", "relative_path": None}, None),
        ({"checker_name": "cross_file_consistency_checker"}, None), ({"checker_name": "cross_file_consistency_checker", "evidence": "again"}, "repeated"), ({"checker_name": "readme_fact_actuality_checker", "confidence": 0.1, "line": 3}, None), ({"checker_name": "readme_fact_actuality_checker", "line": 4}, "line"),
        ({"checker_name": "another", "confidence": 0.0}, None),
    ]
    rows = [base | change for change, _ in cases]
    schema = "item_id long, unit_id string, checker_name string, relative_path string, line int, quote string, issue_type string, criterion string, verdict string, confidence double, evidence string, recommendation string"
    items = spark.createDataFrame([(i, *(r[c.split()[0]] for c in schema.split(", ")[1:])) for i, r in enumerate(rows)], schema)
    allowed = spark.createDataFrame([("u", c, "README.md", n) for c in ("spelling_wording_checker", "readme_fact_actuality_checker") for n in (1, 2, 3, 7)], "unit_id string, checker_name string, relative_path string, line int")
    ranges = verdicts.line_ranges(allowed)
    assert sorted(tuple(r) for r in ranges.where("checker_name like 'spell%'").select("first", "last").collect()) == [(1, 3), (7, 7)]
    got = {r["item_id"]: r["gate"] for r in verdicts.gated(items, ranges, readme(spark, "one\nteh two\nthree")).collect()}
    assert got == {i: gate for i, (_, gate) in enumerate(cases)}


def test_nested_reports(spark, tmp_path):
    """Quote, two details, recommendation and type; findings of unknown units and unreadable reports are left out."""
    report = {"units": [{"unit_id": "u", "name": "Unit"}], "findings": [
        {"finding_id": "f1", "unit_id": "u", "criterion": "facts", "checker_name": "c", "severity": "minor", "verdict": "fail", "confidence": 0.5, "quote": " q ", "location": {"file_path": "a.md", "line_start": 3, "line_end": None}, "evidence": [{"detail": "one"}, {"detail": None}, {"detail": "three"}], "recommendation": "do", "extra": {"issue_type": "typo", "more": 1}},
        {"finding_id": "f2", "unit_id": "v"}, {"finding_id": "f3", "unit_id": "u", "location": None, "evidence": None, "extra": {}},
    ]}
    for name, text in (("a", json.dumps(report, indent=1)), ("b", "not json"), ("c", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    got = [tuple(r) for r in findings_json.predictions(findings_json.read_reports(spark, str(tmp_path))).orderBy("pred_idx").select("pred_idx", "finding_id", "project", "line_start", "file_path", "issue_type", "found_text").collect()]
    assert got == [(1 << 32, "f1", "Unit", 3, "a.md", "typo", "q | one | do | typo"), ((1 << 32) + 2, "f3", "Unit", None, None, "", "")]


def test_md5_of_many_grams():
    """Heads of md5 taken many at a time are hashlib's, over one to three blocks; minima are those of the slower way."""
    rng = random.Random(5)
    for alphabet in ("abc ", "aéжж日🙂"):
        texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 5, 33, 34, 700)]
        for gram in (1, 14, 30):
            for text in texts:
                places = np.arange(max(0, len(text) - gram + 1))
                assert similarity._md5(text, places, gram).tolist() == [int(hashlib.md5(text[i : i + gram].encode()).hexdigest()[:15], 16) for i in places]
            for kind in ("md5", "crc32"):
                assert [m.tolist() for m in similarity.minima(texts, gram, 4, kind)] == [similarity.winnowed(t, gram, 4, kind)[0].tolist() for t in texts]


@pytest.mark.parametrize("kind", ["md5", "crc32"])
def test_only_shared_fingerprints_become_rows(spark, monkeypatch, kind):
    """Fingerprints of one text alone leave no rows, and the pairs are those of all sets against all others, over many buckets."""
    monkeypatch.setattr(similarity, "BUCKET", 1 << 9)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(40))
    common, texts = word() * 2, {}
    for i in range(40):
        body = "".join(word() for _ in range(6))
        texts[f"x{i}"] = body + common
        if i % 4 == 0:
            texts[f"y{i}"] = body + common + word() * (i % 3)
            texts[f"z{i}"] = body[20:] + common
    docs = spark.createDataFrame([("text", k, t) for k, t in texts.items()], "language string, unit_id string, text string")
    sets = {k: set(similarity.winnowed(t, 30, 4, kind)[0].tolist()) for k, t in texts.items()}
    rows = similarity.shared_fingerprints(docs, "unit_id", "language", 30, 4, kind).collect()
    assert sorted((r["unit_id"], r["fingerprint"]) for r in rows) == sorted((k, f) for k, s in sets.items() for f in s if sum(f in o for o in sets.values()) > 1)
    want = sorted((a, b, round(len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])), 4)) for a in sets for b in sets if a < b)
    assert found(similarity.similar_units(docs, kind=kind), "a", "b", "similarity") == [w for w in want if w[2] >= 0.8]


def test_a_text_is_split_once(spark):
    """A text is split into lines once, not once for each time that its parts are named, and the lines are those of split_lines."""
    texts = ["a\r\nb\x0bc d\n", "", "\n", "\n\n", "a", "a\n\n", "\r\n", None]
    df = files(spark, *(("u", str(i), "readme", t) for i, t in enumerate(texts)))
    assert lines(df)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    plain = df.select("relative_path", F.posexplode(split_lines(F.col("text"))).alias("n", "line")).select("relative_path", F.col("n") + 1, "line")
    assert found(lines(df), "relative_path", "line_no", "line") == sorted(tuple(r) for r in plain.collect())

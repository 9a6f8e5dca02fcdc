"""Matching and scores against plain Python on random small inputs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

import pytest

from corpusloom.operators import adjudicate, align, evaluate, findings, matching


def greedy(rows, key):
    gold, pred, out = set(), set(), []
    for r in sorted(rows, key=key):
        if r["gold_idx"] not in gold and r["pred_idx"] not in pred:
            gold.add(r["gold_idx"]), pred.add(r["pred_idx"]), out.append((r["gold_idx"], r["pred_idx"]))
    return sorted(out)


def test_soft_matches(spark):
    rng = random.Random(1)
    gold = [(i, f"u{rng.randrange(3)}", rng.choice("ab"), "minor", rng.choice(["README.md", "x.md", None]), rng.choice([None, 1, 2, 3, 9])) for i in range(40)]
    pred = [(i, f"u{rng.randrange(3)}", rng.choice("ab"), rng.choice(["readme_rus.md", "x.md", None]), rng.choice([None, 1, 3, 8])) for i in range(40)]
    g = spark.createDataFrame(gold, "gold_idx long, unit_id string, criterion string, severity string, file_path string, line_start int")
    p = spark.createDataFrame(pred, "pred_idx long, unit_id string, criterion string, file_path string, line_start int")
    c = evaluate.soft_candidates(g, p)
    rows = c.collect()
    for parts in (1, 7):
        m = evaluate.soft_matches(c.repartition(parts))
        assert sorted((r["gold_idx"], r["pred_idx"]) for r in m.collect()) == greedy(rows, lambda r: (-r["score"], -r["gold_idx"], -r["pred_idx"]))
    x = evaluate.precision_recall(g, p, m).first()
    n = len(greedy(rows, lambda r: (-r["score"], -r["gold_idx"], -r["pred_idx"])))
    assert (x["true_positive"], x["false_positive"], x["false_negative"], x["precision"]) == (n, 40 - n, 40 - n, round(n / 40, 4))


@pytest.mark.parametrize("batch", [7, 60, 50_000])
@pytest.mark.parametrize("order", [[("score", False), ("gold_idx", False), ("pred_idx", False)], [("same", False), ("score", False), ("gold_idx", True), ("pred_idx", True)]])
def test_parallel_matching(spark, monkeypatch, batch, order):
    """As the sequential loop, with ties and a third of all pairs in one scope, in batches of any size."""
    monkeypatch.setattr(matching, "BATCH", batch)
    rng = random.Random(batch)
    pairs = {(s, s * 100 + rng.randrange(25), s * 100 + rng.randrange(25)) for s in [0] * 200 + list(range(1, 8)) * 60}
    rows = [{"scope": s, "gold_idx": g, "pred_idx": p, "score": rng.choice([0.5, 0.75, 0.9, 1.0]), "same": rng.random() < 0.5} for s, g, p in pairs]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "scope long, gold_idx long, pred_idx long, score double, same boolean").repartition(5)
    key = lambda r: tuple(r[c] if up else -r[c] for c, up in order)
    got = sorted((r["gold_idx"], r["pred_idx"]) for r in matching.greedy(df, ["scope"], order).collect())
    assert got == sorted(p for s in range(8) for p in greedy([r for r in rows if r["scope"] == s], key))


def test_no_group_in_one_task(spark, monkeypatch):
    """Pairs of one scope that all tie: no task sees more than a batch of them."""
    monkeypatch.setattr(matching, "BATCH", 50)
    seen = spark.sparkContext.accumulator(0)
    plain = matching.first_batch

    def counted(x, scope, order, ends):
        most = x.groupBy(*scope).count().agg(F.max("count")).first()[0] or 0
        got = plain(x, scope, order, ends)
        seen.add(1)
        assert most <= 50 or got.count() <= 50
        return got

    monkeypatch.setattr(matching, "first_batch", counted)
    df = spark.range(400).selectExpr("0 as scope", "id div 20 as gold_idx", "id % 20 as pred_idx", "1.0D as score")
    got = sorted((r["gold_idx"], r["pred_idx"]) for r in matching.greedy(df, ["scope"], [("score", False), ("gold_idx", True), ("pred_idx", True)]).collect())
    assert got == [(i, i) for i in range(20)] and seen.value > 2
    assert matching.greedy(df.where("false"), ["scope"], [("score", False), ("gold_idx", True), ("pred_idx", True)]).count() == 0


def test_small_scopes_share_a_pass(spark, monkeypatch):
    """Thousands of small scopes, keyed by two columns, are decided by one pass over each task's rows, also where Arrow batches cut through a scope."""
    rng = random.Random(4)
    pairs = {(s, c, 10 * s + rng.randrange(4), 10 * s + rng.randrange(4)) for s in range(600) for c in "xy" for _ in range(5)}
    rows = [{"unit": s, "criterion": c, "gold_idx": g, "pred_idx": p, "score": rng.choice([0.5, 0.75, 0.9])} for s, c, g, p in pairs]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "unit long, criterion string, gold_idx long, pred_idx long, score double")
    order = [("score", False), ("gold_idx", True), ("pred_idx", True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = matching.greedy(df, ["unit", "criterion"], order)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        got = sorted((r["unit"], r["criterion"], r["gold_idx"], r["pred_idx"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    scopes = {}
    for r in rows:
        scopes.setdefault((r["unit"], r["criterion"]), []).append(r)
    assert got == sorted((*k, *p) for k, v in scopes.items() for p in greedy(v, lambda r: (-r["score"], r["gold_idx"], r["pred_idx"])))


def test_strict_ladder(spark):
    gold = [(1, "p", "readability", "The heading is repeated twice here", 10, 12), (2, "p", "readability", "pcap dump: whoami is missing", None, None), (3, "p", "readability", "entirely different words", 50, 50), (4, "q", "facts", "nothing near", None, None)]
    pred = [(11, "p", "readability", "heading repeated", 11, 11), (12, "p", "readability", "whoami not found in the capture", 90, 90), (13, "p", "readability", "zzz qqq", 52, 52)]
    g = spark.createDataFrame(gold, "gold_idx long, project_id string, criterion string, gold_text string, line_start int, line_end int")
    p = spark.createDataFrame(pred, "pred_idx long, project_id string, criterion string, found_text string, line_start int, line_end int")
    rows = {r["gold_idx"]: r for r in evaluate.strict_matches(g, evaluate.pair_scores(g, p)).collect()}
    assert rows[1]["match_type"] == "line_and_text" and rows[1]["pred_idx"] == 11 and rows[1]["counted"]
    assert rows[2]["match_type"] == "artifact_missing_signal" and rows[2]["counted"]
    assert not rows[3]["counted"] and rows[3]["pred_idx"] == 13 and rows[4]["match_type"] == "missed"


def test_text_scores_are_filtered_and_verified(spark):
    """As each pair by itself; equal pairs are compared once, and letters keep most hopeless ones from being compared."""
    rng = random.Random(12)
    words = ["heading", "заголовок", "zzz", "qqq", "7", "раздел", "link", "file", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(5))) for _ in range(40)]
    rows = [(i, texts[rng.randrange(40)], texts[rng.randrange(40)]) for i in range(300)] + [(300 + i, "aaaa bbbb", "zz yy ww") for i in range(50)]
    df = spark.createDataFrame(rows, "i int, a string, b string").withColumns({"letters_a": evaluate.letter_counts(F.col("a")), "letters_b": evaluate.letter_counts(F.col("b"))})
    got = {r["i"]: r for r in evaluate.text_scored(df).collect()}
    for i, a, b in rows:
        x, y = set(a.split()), set(b.split())
        overlap = len(x & y) / max(1, min(len(x), len(y)))
        exact = SequenceMatcher(a=a, b=b).ratio()
        want = 0.0 if not a or not b else 0.95 if a in b or b in a else round(max(overlap, exact), 4)
        assert got[i]["text"] == want or (not got[i]["verified"] and max(want, got[i]["text"]) <= evaluate.IDLE), (a, b)
    assert sum(r["verified"] for r in got.values()) < 0.8 * len(rows) and not any(got[300 + i]["verified"] for i in range(50))


@pytest.mark.parametrize("blocks", [(256, 4096), (3, 5)])
def test_prescreen_as_all_pairs(spark, monkeypatch, blocks):
    """The best of all pairs by the plain ladder, with any blocks; few texts are compared."""
    monkeypatch.setattr(align, "GOLD_BLOCK", blocks[0])
    monkeypatch.setattr(align, "PRED_BLOCK", blocks[1])
    rng = random.Random(31)
    words = ["heading", "twice", "wrong", "number", "table", "a.md", "b.py", "order", "missing", "stale", "link", "field"]
    row = lambda i: (i, rng.choice("pq"), rng.choice("rs"), " ".join(rng.choices(words, k=rng.randrange(1, 7))), rng.choice([None, "README.md", "x.md"]), line := rng.choice([None, 3, 5, 40]), line)
    gold, pred = [row(i) for i in range(25)], [row(100 + i) for i in range(60)]
    g = spark.createDataFrame(gold, "gold_idx long, project_id string, criterion string, gold_text string, file_hint string, line_start int, line_end int")
    p = spark.createDataFrame(pred, "pred_idx long, project_id string, criterion string, found_text string, file_path string, line_start int, line_end int")
    got = align.prescreened(g, p, 4).collect()
    files = lambda t: {w for w in t.split() if w in ("a.md", "b.py")}
    plain = lambda t: t.replace(".", " ")
    tokens = lambda t: {w for w in plain(t).split() if len(w) > 2}
    want = set()
    for gi, project, criterion, text, hint, start, _ in gold:
        found = []
        for pi, other, own, said, path, line, _ in pred:
            if other != project:
                continue
            close = start is not None and line is not None and abs(start - line) <= 2
            theirs = files(said) | ({path.lower()} if path else set())
            if files(text) & theirs:
                score = 1.0
            elif hint and hint == path and close:
                score = 0.9
            elif hint and hint == path and start is None:
                score = 0.84
            else:
                x, y = tokens(text), tokens(said)
                score = (max(len(x & y) / max(1, min(len(x), len(y))), SequenceMatcher(a=plain(text), b=plain(said)).ratio()) if x and y else 0.0) + (0.1 if close else 0.0)
            if score >= 0.1:
                found.append((criterion == own, score, -pi))
        want |= {(gi, -q, same, round(score, 9), k + 1) for k, (same, score, q) in enumerate(sorted(found, reverse=True)[:4])}
    assert {(r["gold_idx"], r["pred_idx"], r["same"], round(r["score"], 9), r["rank"]) for r in got} == want
    if blocks[0] == 256:
        assert sum({r["gold_idx"]: r["compared"] for r in got}.values()) < 0.4 * sum(g[1] == p[1] for g in gold for p in pred)


def test_line_relation(spark):
    df = spark.createDataFrame([(1, 3, 3, 5), (1, 1, 3, 3), (1, 1, 4, 4), (None, None, 1, 1), (5, None, 5, None)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(evaluate.line_relation(*map(F.col, "abcd"))).collect()] == ["overlap", "near", "far", "none", "overlap"]


def test_alignment(spark):
    gold = [(1, "p", "links", "Broken https://a.example/x link", None, None, None), (2, "p", "facts", "заголовок разделов повторяется", 4, 4, "README.md")]
    pred = [(11, "p", "facts", "заголовки раздела повторяются", "README_RUS.md", 5, 5), (12, "p", "links", "see https:/a.example/x", "README.md", 9, 9)]
    g = spark.createDataFrame(gold, "gold_idx long, project_id string, criterion string, gold_text string, line_start int, line_end int, file_hint string")
    p = spark.createDataFrame(pred, "pred_idx long, project_id string, criterion string, found_text string, file_path string, line_start int, line_end int")
    got = sorted((r["gold_idx"], r["pred_idx"]) for r in align.assigned(align.judged(align.prescreened(g, p))).collect())
    assert got == [(1, 12), (2, 11)]


def test_stems(spark):
    df = spark.createDataFrame([("разделами",), ("дом",), ("tests",)], "t string")
    assert [r[0] for r in df.select(align.stem(F.col("t"))).collect()] == ["раздел", "дом", "tests"]


def test_adjudication(spark):
    df = spark.createDataFrame([("q | d | f | typo",), ("q | d | a | b",), ("",), (None,)], "s string")
    got = [tuple(r[0]) for r in df.select(adjudicate.issue_parts(F.col("s"))).collect()]
    assert got == [("q", "d", "f", "typo"), ("q", "d", "a", "b"), ("", "", "", "other"), ("", "", "", "other")]
    n = spark.createDataFrame([(0,), (5,), (100,), (1000,)], "n long").select(adjudicate.sample_size(F.col("n"), 0.15)).collect()
    assert [r[0] for r in n] == [0, 5, 31, 41]
    w = spark.createDataFrame([(0, 0), (5, 10)], "s long, n long").select(adjudicate.wilson(F.col("s"), F.col("n")).alias("w")).select("w.*").collect()
    assert tuple(w[0]) == (0.0, 0.0, 1.0) and abs(w[1]["low"] - 0.2366) < 1e-4 and abs(w[1]["high"] - 0.7634) < 1e-4


def test_sample_ignores_partitions(spark):
    rows = spark.range(500).selectExpr("id as finding_id", "case when id % 50 = 0 then 'rare' else 'common' end as subtype")
    a, b = (sorted(r["finding_id"] for r in adjudicate.stratified_sample(rows.repartition(k)).collect()) for k in (1, 7))
    assert a == b and sum(x % 50 == 0 for x in a) == 10


def make(spark, **values):
    row = {"unit_id": "u", "checker_name": "c", "criterion": "readability", "severity": "minor", "verdict": "warning", "confidence": 0.9} | values
    schema = ", ".join(f"{k} {'double' if k == 'confidence' else 'string'}" for k in row)
    return findings.findings(spark.createDataFrame([tuple(row.values())], schema))


def test_calibration(spark):
    x = findings.calibrated(make(spark, criterion="workload", severity="critical", verdict="fail")).first()
    assert (x["severity"], x["verdict"]) == ("info", "unknown") and x["extra"]["original_severity"] == "critical"
    x = findings.calibrated(make(spark, criterion="market_fit", severity="critical", verdict="fail", source="s")).first()
    assert (x["severity"], x["verdict"]) == ("major", "fail")


def test_cleanup(spark):
    reason = lambda **v: make(spark, **v).select(findings.drop_reason()).first()[0]
    assert reason(support_status="ошибка проверки") == "tool_error"
    assert reason(checker_name="readability_checker", verdict="unknown", confidence=0.0) == "empty_model_result"
    assert reason(checker_name="tech_freshness_checker", criterion="technology_freshness", verdict="unknown", confidence=0.2) == "low_evidence"
    assert reason(checker_name="model_rubric_checker", criterion="rights") == "rights_duplicate" and reason() is None
    assert findings.normalized(make(spark, verdict="fail", severity="info")).first()["severity"] == "minor"


def test_collapse(spark):
    a, b, c = (make(spark, file_path=p, recommendation="same", confidence=f) for p, f in (("README.md", 0.8), ("README_RUS.md", 0.9), ("other.md", 0.9)))
    got = {r["file_path"]: r["extra"].get("affected_files") for r in findings.collapsed(a.union(b).union(c)).collect()}
    assert got == {"README_RUS.md": "README.md, README_RUS.md", "other.md": None}

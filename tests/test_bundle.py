"""Several tables as one commit, and the tables of an evaluation."""

import pytest

from corpusloom.operators import evaluate, sinks
from tests.test_evaluation import make


def test_commits_are_whole(spark, tmp_path):
    """A write is seen once its manifest is there; what a broken one leaves isn't; earlier commits stay."""
    bundle = sinks.Bundle(spark, f"file://{tmp_path}/b")
    with pytest.raises(FileNotFoundError):
        bundle.tables()
    assert bundle.write({"a": spark.range(3), "b": spark.createDataFrame([(1, ["x"])], "i int, l array<string>")}) == 1
    assert bundle.tables()["b"].first()["l"] == '["x"]'
    broken = spark.range(5).selectExpr("cast(raise_error('broken') as string) as id")
    with pytest.raises(Exception, match="broken"):
        bundle.write({"a": spark.range(9), "b": broken})
    assert bundle.versions() == [1] and bundle.tables()["a"].count() == 3
    assert bundle.write({"a": spark.range(7)}, "parquet") == 2 and bundle.tables()["a"].count() == 7 and set(bundle.tables()) == {"a"}
    assert bundle.tables(1)["a"].count() == 3 and [f.name for f in tmp_path.glob("b/_manifests/*.json")]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two commits with the same number the second fails and changes nothing."""
    first, second = (sinks.Bundle(spark, f"file://{tmp_path}/b") for _ in range(2))
    monkeypatch.setattr(second, "versions", lambda: [])
    first.write({"a": spark.range(3)})
    with pytest.raises(RuntimeError, match="number 1"):
        second.write({"a": spark.range(4)})
    assert first.tables()["a"].count() == 3


def test_report(spark, tmp_path):
    rows = make(spark, severity="major").unionByName(make(spark, verdict="pass")).unionByName(make(spark, unit_id="v", criterion="facts"))
    units = spark.createDataFrame([("u", "U"), ("v", "V"), ("w", "W")], "unit_id string, name string")
    assert sinks.write_report(rows, f"file://{tmp_path}/r", units, spark.range(5)) == 1
    got = sinks.Bundle(spark, f"file://{tmp_path}/r").tables()
    assert tuple(got["totals"].first()) == (3, 5, 2, 2) and got["report"].count() == got["findings"].count() == 2
    assert {(r["dimension"], r["value"]): r["n"] for r in got["summary"].collect()}[("severity", "major")] == 1


def test_ten_tables(spark):
    gold = [(1, "p", "facts", "heading twice", 3, 3), (2, "p", "facts", "other words", 90, 90), (3, "q", "links", "dead link", None, None), (4, "q", "facts", "unseen", None, None)]
    found = [(11, "p", "facts", "link_checker", "heading twice", 3, 3), (12, "p", "facts", "c", "nothing like it", 50, 50), (13, "q", "links", "c", "zzz", None, None), (14, "q", "rights", "c", "out of scope", 1, 1)]
    g = spark.createDataFrame(gold, "gold_idx long, project_id string, criterion string, gold_text string, line_start int, line_end int")
    p = spark.createDataFrame(found, "pred_idx long, project_id string, criterion string, checker_name string, found_text string, line_start int, line_end int")
    tables = {n: x.collect() for n, x in evaluate.evaluation(g, p).items()}
    assert tuple(tables) == evaluate.BUNDLE
    s = tables["summary"][0]
    assert (s["gold_total"], s["predicted_total"], s["true_positive"], s["false_positive"], s["false_negative"], s["precision"], s["recall"], s["f1_score"]) == (4, 3, 1, 2, 3, 0.3333, 0.25, 0.2857)
    assert {r["gold_idx"]: (r["counted"], r["pred_idx"], r["checker_name"]) for r in tables["main"]} == {1: (True, 11, "link_checker"), 2: (False, 12, "c"), 3: (False, 13, "c"), 4: (False, None, None)}
    assert {r["gold_idx"]: r["reason_code"] for r in tables["false_negative_analysis"]} == {2: "near_miss", 3: "near_miss", 4: "other_criterion"}
    assert {r["slice_name"]: (r["predicted_total"], r["true_positive"], r["false_positive_share"]) for r in tables["by_checker_group"]} == {"links_and_resources": (1, 1, 0.0), "other": (2, 0, 1.0)}
    assert [tuple(r) for r in tables["false_negative"]] == [("q", "facts")] and [tuple(r) for r in tables["false_positive"]] == [("q", "rights")]
    assert {r["pred_idx"] for r in tables["false_positive_detailed"]} == {12, 13}
    assert {r["criterion"]: (r["gold_total"], r["predicted_total"], r["true_positive"]) for r in tables["overview_by_criterion"]} == {"facts": (2, 1, 1), "links": (1, 1, 1), "rights": (0, 1, 0)}

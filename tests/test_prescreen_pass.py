"""The prescreen starts no Python group for each project, and stems are taken once a row."""

from pyspark.sql import functions as F

from corpusloom.operators import align

GOLD = "gold_idx long, project_id string, criterion string, gold_text string, file_hint string, line_start int, line_end int"
FOUND = "pred_idx long, project_id string, criterion string, found_text string, file_path string, line_start int, line_end int"


def test_one_pass_over_all_projects(spark):
    g = spark.createDataFrame([(i, f"p{i // 2}", "c", "Раздел повторяется дважды", None, None, None) for i in range(60)], GOLD)
    p = spark.createDataFrame([(100 + i, f"p{i}", "c", "Разделами повторяется", None, None, None) for i in range(40)], FOUND)
    x = align.prescreened(g, p)
    assert sorted((r["gold_idx"], r["pred_idx"], r["rank"]) for r in x.collect()) == [(i, 100 + i // 2, 1) for i in range(60)]
    assert "CoGroup" not in x._jdf.queryExecution().toString()


def test_judged_uses_given_stems(spark):
    x = spark.createDataFrame([("a b", "c d", ["abcde", "fghij"], ["abcde", "fghij"], 0.2, "far")], "gold_text string, found_text string, gold_stems array<string>, found_stems array<string>, score double, relation string")
    assert [r["confidence"] for r in align.judged(x).collect()] == [0.72]
    assert not align.judged(x.drop("gold_stems", "found_stems")).take(1)


def test_stems_of_texts(spark):
    df = spark.createDataFrame([(1, "Разделами раздел, ДОМАМИ если tests шкалой"), (2, ""), (3, None)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(align.stems(F.col("t"))).collect()] == [["раздел", "домам", "если", "tests", "шкал"], [], []]

"""Questions are held against READMEs and artifacts in one pass."""

from corpusloom.operators import checklists


def test_grounding_reads_texts_once(spark):
    asked = [
        ("u", "check-list.yml", 0, "Task 2: pairs", 'Check that `id ` and tcpdump give the expected output "Anna", see dump.pcap and `a  b.csv` of A  B.CSV', None),
        ("u", "check-list.yml", 1, "Other", "whoami is named here and x.docx", None),
        ("v", "check-list.yml", 0, "Task 2", "select a from t where p1.age = 5", None),
    ]
    asked = spark.createDataFrame(asked, checklists.QUESTIONS)
    shown = spark.createDataFrame([("u", "whoami\n# Task 2\nnothing"), ("v", "# Task 2\nage")], "unit_id string, readme string")
    paths = spark.createDataFrame([("u", "ex2/dump.pcap"), ("u", "x_1.docx"), ("u", "a b.csv")], "unit_id string, relative_path string")
    artifacts = spark.createDataFrame([("u", "dump.pcap", "tcpdump listening"), ("u", "dump.pcap", "id")], "unit_id string, ref string, text string")
    found = checklists.grounding(asked, shown, paths, artifacts)
    assert sorted((r["unit_id"], r["q_index"], r["issue_type"], r["evidence"]) for r in found.collect()) == [
        ("u", 0, "artifact_missing_expected_text", "Anna не найден в dump.pcap"), ("u", 0, "expected_file_name_mismatch", "a  b.csv vs a b.csv"),
        ("u", 0, "ungrounded_command", "id"), ("u", 0, "ungrounded_command", "tcpdump"), ("u", 1, "ungrounded_resource", "x.docx"), ("v", 0, "ungrounded_sql_condition", "p1.age = 5"),
    ]
    # what was found in the texts of READMEs and artifacts is written; nothing looks for it again
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "tcpdump" not in plan and "pizzer" not in plan

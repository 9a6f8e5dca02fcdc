"""Lines that are left out before sections are followed, and normal forms that are made once."""

from pyspark.sql import functions as F

from corpusloom.functions.text import needles
from corpusloom.operators import context, evaluate


def test_fact_lines_keep_split_words(spark):
    lines = ["It is do[ck](https://x.example)er that all of the users run here", "nothing of it is said in any of these words", "## Task 1", "The release of 2020 was published by its own team", "## Theory", "The release of 2021 was published by its own team"]
    rows = spark.createDataFrame([("u", "README.md", "readme", i, x) for i, x in enumerate(lines, 1)], "unit_id string, relative_path string, kind string, line_no int, line string")
    found = context.fact_lines(rows, "(?i)(docker)")
    assert sorted(r["line_no"] for r in found.collect()) == [1, 6]
    assert needles("(?i)(docker)") == needles("(?iuU)docker") == {"docker"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains(line") > plan.index("Window") if "Contains(line" in plan else "contains" in plan.lower()[plan.index("Window") :].lower()


def test_artifact_words(spark):
    texts = ["Команда whoami: в дампе нет вывода", "tcpdump capture is missing", "whoami works", "the log of who-id is missing", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.select(evaluate.artifact_words(F.col("t")).alias("w"))
    assert [r["w"] for r in got.collect()] == [["whoami"], ["tcpdump"], [], [], []]
    said = df.where(evaluate.missing_artifact(F.col("t"), F.col("t")))
    # the normal form stands in the plan once for each side, not once for each pattern
    assert said._jdf.queryExecution().optimizedPlan().toString().count("https?") <= 2

"""Plain strings that rule out a pattern lose none of its matches."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import folded, may_match, needles, once, pattern, strip
from corpusloom.operators import context, curriculum, readability, resources

RULES = (
    *(p for both in context.MARKET.values() for p in both), *(p for _, p in readability.EDITORIAL), readability.ASP_NET, resources.FILE_REF,
    *(getattr(curriculum, n) for n in ("JAVA", "C_LANGUAGE", "CPP", "CSHARP", "CPP_STYLE", "ASP_NET", "MAKEFILE", "C_STANDARD", "REVIEW", "NO_GOTO")),
)
LINES = (
    "KPI und Churn", "the DATASETS of data source", "ſla of the Kaggle set", "buſıness problem", "Real Data", "клиентская  база", "НАБОР   ДАННЫХ", "наᲁор ᲁанных", "датасетами", "see `a b.CSV` or x.tar.gz", "my_data.PİNG and a.pıng",
    "COMANY", "В компании  работались", "ASP.net ASPNET", "never use the goto", "Google C++ long style", "make the build", "C11", "#  define x", "# İnclude", "state  machine", "конечный автомат", "in C.", "nothing of it", "", "данные клиентов",
)


def test_no_match_is_lost(spark):
    df = once(spark.createDataFrame([(x,) for x in LINES], "line string"), low=folded(F.col("line")))
    hits = [F.col("line").rlike(pattern(p, True)) for p in RULES]
    lost = df.select(*(F.count(F.when(h & ~may_match(F.col("low"), p), 1)) for h, p in zip(hits, RULES))).first()
    assert not any(lost)
    assert all(needles(p) for p in RULES)
    assert df.where(may_match(F.col("low"), *(p for both in context.MARKET.values() for p in both))).where("line = 'nothing of it'").count() == 0


@pytest.mark.parametrize("p, found", [("a(?:b|c)d", {"abd", "acd"}), (r"\bfoo\s+(bar|bazz)?", {"foo"}), ("[^a]*", None), ("(x|)", None), (r"datasets?\b|net", {"dataset", "net"}), (r"(?:ab){2,}", {"ab"}), (r"\x{2028}", None)])
def test_needles(p, found):
    assert needles(p) == (found and frozenset(found))


def test_strip_and_fences(spark):
    df = spark.createDataFrame([(" \x1f a b　\n",), ("​x ",), (" \n ",), (None,)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "​x", "", None]


def test_editorial_sorts_few_lines(spark):
    """Only fences and lines that a rule may hit are put in order."""
    text = [(i, x) for i, x in enumerate(["plain"] * 50 + ["```", "COMANY", " ``` ", "Our COMANY", "plain ``` plain", "`x` and \"Name of it\""], 1)]
    rows = spark.createDataFrame([("u", "a.md", "readme", i, x) for i, x in text], "unit_id string, relative_path string, kind string, line_no int, line string")
    seen = spark.sparkContext.accumulator(0)
    plain = readability.prose_lines

    def counted(x):
        seen.add(x.count())
        return plain(x)

    readability.prose_lines = counted
    try:
        got = readability.editorial(rows).collect()
    finally:
        readability.prose_lines = plain
    assert sorted((r["line_start"], r["issue_type"]) for r in got) == [(54, "typo"), (56, "quote_style")]
    assert seen.value == 5

"""Stored verdicts of models: reading, gating and counting them. No model is called."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze

# Synonyms and words.
VERDICTS = {"pass": "pass", "ok": "pass", "supported": "pass", "warning": "warning", "warn": "warning", "outdated": "warning", "fail": "fail", "error": "fail", "incorrect": "fail", "unknown": "unknown", "unclear": "unknown"}
CONFIDENCE = {"high": 0.9, "высокая": 0.9, "medium": 0.6, "средняя": 0.6, "low": 0.3, "низкая": 0.3}
ITEM = "struct<verdict:string,severity:string,confidence:string,quote:string,line:int,issue_type:string,evidence:string,recommendation:string,sources:array<struct<title:string,url:string>>>"

#: What each checker asks of a model's item, in the order in which it is asked. A row without issue_type holds for all types
#: that have no row of their own; without a list everything is allowed.
# Thresholds, types and criteria.
GATES = (
    # checker_name, issue_type, least confidence, dropped verdicts, types, criteria, quote in its line, line among the given ones, texts it needs
    ("spelling_wording_checker", None, 0.65, (), ("typo", "tautology", "case", "wording", "quote_style"), None, True, True, ("quote", "evidence", "recommendation")),
    ("curriculum_relevance_checker", None, 0.55, ("pass",), None, ("correctness", "technology_freshness"), False, False, ()),
    ("curriculum_relevance_checker", "language_material_conflict", 0.62, ("pass",), None, ("correctness", "technology_freshness"), False, False, ()),
    ("curriculum_relevance_checker", "language_tooling_conflict", 0.62, ("pass",), None, ("correctness", "technology_freshness"), False, False, ()),
    ("curriculum_relevance_checker", "inappropriate_tool", 0.65, ("pass",), None, ("correctness", "technology_freshness"), False, False, ()),
    ("curriculum_relevance_checker", "outdated_approach", 0.72, ("pass",), None, ("correctness", "technology_freshness"), False, False, ()),
    ("curriculum_relevance_checker", "missing_key_topic", 0.74, ("pass",), None, ("correctness", "technology_freshness"), False, False, ()),
    ("curriculum_relevance_checker", "absolute_practice_claim", 0.7, ("pass",), None, ("correctness", "technology_freshness"), False, False, ()),
    ("model_rubric_checker", None, 0.7, ("unknown",), None, None, False, False, ()),
    ("cross_file_consistency_checker", None, 0.6, (), None, None, False, False, ()),
    ("readme_fact_actuality_checker", None, 0.0, (), None, None, False, True, ()),
)
GATE = "checker_name string, gate_type string, least double, dropped array<string>, types array<string>, criteria array<string>, anchored boolean, lined boolean, needs array<string>"
#: Tools that are no conflict by being named, types for which that holds, and words that make them one.
TOOLS, TOOL_TYPES, FOREIGN = ("makefile", "google c++ style", "cppguide"), ("inappropriate_tool", "outdated_approach", "language_material_conflict", "language_tooling_conflict"), (" java", "java-", "asp.net", "c#")


def _lookup(value: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), F.lower(F.trim(value)))


def verdict(value: Column, default: str = "unknown") -> Column:
    return F.coalesce(_lookup(value, VERDICTS), F.lit(default))


def confidence(value: Column) -> Column:
    """A number or percentage clamped to 0..1, or a word; 0.5 if it can't be read."""
    text = F.trim(F.coalesce(value, F.lit("")))
    number = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), "%$", "").try_cast("double")
    number = F.when(text.endswith("%"), number / 100).otherwise(number)
    return F.coalesce(_lookup(text, CONFIDENCE), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), F.lit(0.5))


def items(response: Column) -> Column:
    """The items of a response: a list, an object with findings, results or items, or one object."""
    wrapped = F.from_json(response, f"struct<findings:array<{ITEM}>,results:array<{ITEM}>,items:array<{ITEM}>>")
    many = F.from_json(response, f"array<{ITEM}>")
    one = F.array(F.from_json(response, ITEM))
    return F.when(F.ltrim(response).startswith("["), many).otherwise(F.coalesce(wrapped["findings"], wrapped["results"], wrapped["items"], one))


def verdict_rows(verdicts: DataFrame) -> DataFrame:
    """namespace, cache_key, model, item_no and the item's fields, read from stored responses; items that say nothing are left out."""
    keep = [c for c in verdicts.columns if c != "response"]
    x = verdicts.select(*keep, F.posexplode(items(F.col("response"))).alias("item_no", "i")).where("i is not null")
    x = x.select(*keep, "item_no", verdict(F.col("i.verdict")).alias("verdict"), F.lower(F.trim("i.severity")).alias("severity"), confidence(F.col("i.confidence")).alias("confidence"), "i.quote", "i.line", "i.issue_type", F.trim("i.evidence").alias("evidence"), F.trim("i.recommendation").alias("recommendation"), F.filter(F.coalesce("i.sources", F.array().cast("array<struct<title:string,url:string>>")), lambda s: F.coalesce(s["url"], F.lit("")) != "").alias("sources"))
    empty = (F.col("verdict") == "unknown") & (F.col("confidence") <= 0) & (F.coalesce("evidence", F.lit("")) == "") & (F.size("sources") == 0)
    return x.where(~empty)


def anchored(rows: DataFrame, lines: DataFrame, least: float = 0.65) -> DataFrame:
    """Items whose quote stands in the line that they name (unit_id, relative_path, line), with at least that confidence."""
    x = rows.where(F.col("confidence") >= least).join(lines.select("unit_id", "relative_path", F.col("line_no").alias("line"), F.col("line").alias("line_text")), ["unit_id", "relative_path", "line"])
    return x.where((squeeze(F.coalesce("quote", F.lit(""))) != "") & F.lower(squeeze(F.col("line_text"))).contains(F.lower(squeeze(F.col("quote"))))).drop("line_text")


def line_ranges(allowed: DataFrame) -> DataFrame:
    """allowed (unit_id, checker_name, relative_path, line) -> first, last: runs of neighbouring lines as ranges."""
    keys = ["unit_id", "checker_name", "relative_path"]
    x = allowed.select(*keys, "line").distinct()
    x = x.withColumn("run", F.col("line") - F.row_number().over(W.partitionBy(*keys).orderBy("line")))
    return x.groupBy(*keys, "run").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("run")


def gated(rows: DataFrame, ranges: DataFrame, lines: DataFrame, gates: tuple = GATES) -> DataFrame:
    """rows with `gate`: the first gate of its checker that an item fails (confidence, verdict, issue_type, criterion, text, tooling, line, quote, place, repeated), null if it passes all.

    rows (item_id, unit_id, checker_name, relative_path, line, quote, issue_type, criterion, verdict, confidence, evidence,
    recommendation) are the items of all checkers. ranges (unit_id, checker_name, relative_path, first, last) are the lines
    that a model was shown, lines the lines of files. Checkers without gates pass. item_id names a row.
    """
    table = rows.sparkSession.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in g) for g in gates], GATE)
    fallback = table.where("gate_type is null").drop("gate_type")
    own = table.where("gate_type is not null").select("checker_name", F.col("gate_type").alias("issue_type"), F.col("least").alias("own_least"))
    x = rows.join(F.broadcast(fallback), "checker_name", "left").join(F.broadcast(own), ["checker_name", "issue_type"], "left")  # a row per gate
    # one interval join for all checkers, and one for the line itself
    shown = ranges.select("unit_id", "checker_name", "relative_path", "first", "last")
    inside = x.where("lined").select("item_id", "unit_id", "checker_name", "relative_path", "line").join(shown, ["unit_id", "checker_name", "relative_path"]).where("line between first and last").select("item_id").distinct()
    text = lines.select("unit_id", "relative_path", F.col("line_no").alias("line"), F.col("line").alias("line_text"))
    x = x.join(inside.withColumn("inside", F.lit(True)), "item_id", "left").join(text, ["unit_id", "relative_path", "line"], "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    said = F.lower(F.concat_ws(" ", "quote", "evidence", "recommendation"))
    among = lambda words: reduce(Column.__or__, (said.contains(w) for w in words))
    needs = reduce(Column.__or__, (F.array_contains("needs", c) & blank(c) for c in ("quote", "evidence", "recommendation")))
    curriculum, rubric, cross = (F.col("checker_name") == c for c in ("curriculum_relevance_checker", "model_rubric_checker", "cross_file_consistency_checker"))
    again = F.row_number().over(W.partitionBy("unit_id", "checker_name", "relative_path", F.substring("quote", 1, 160)).orderBy("item_id"))
    x = x.withColumn("gate", F.when(F.col("least").isNull(), None)
        .when(F.coalesce("confidence", F.lit(0.0)) < F.coalesce("own_least", "least"), "confidence")
        .when(F.array_contains("dropped", F.coalesce("verdict", F.lit("unknown"))), "verdict")
        .when(F.col("types").isNotNull() & ~F.coalesce(F.array_contains("types", F.lower(F.trim("issue_type"))), F.lit(False)), "issue_type")
        .when(F.col("criteria").isNotNull() & ~F.coalesce(F.array_contains("criteria", F.col("criterion")), F.lit(False)), "criterion")
        .when(needs | (curriculum & (F.trim(said) == "")), "text")
        .when(curriculum & F.coalesce(F.col("issue_type").isin(*TOOL_TYPES), F.lit(False)) & among(TOOLS) & ~among(FOREIGN), "tooling")
        .when(F.col("lined") & F.col("inside").isNull(), "line")
        .when(F.col("anchored") & ~F.coalesce(F.col("line_text").contains(F.col("quote")), F.lit(False)), "quote")
        .when(rubric & F.col("relative_path").isNull() & blank("quote"), "place"))
    passed = x.where(cross & F.col("gate").isNull()).select("item_id", again.alias("again")).where("again > 1").withColumn("_repeated", F.lit("repeated")).drop("again")
    x = x.join(passed, "item_id", "left").withColumn("gate", F.coalesce("gate", "_repeated"))
    return x.select(*rows.columns, "gate")


def usage(verdicts: DataFrame) -> DataFrame:
    """model, calls, cache_hits, tokens and cost; 'all' is the total. verdicts have model, cache_hit and usage."""
    x = verdicts.select(F.explode(F.array(F.col("model"), F.lit("all"))).alias("model"), F.coalesce("cache_hit", F.lit(False)).alias("hit"), "usage.*")
    fresh = lambda c: F.sum(F.when(~F.col("hit"), F.col(c)).otherwise(0))
    return x.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("hit"), 1)).alias("cache_hits"), *(fresh(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "cost_usd")))

"""Findings: construction, calibration, clean-up, collapse, summary and triage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..schema import EVIDENCE, FINDING_COLUMNS, severity_rank

# Names and thresholds of the rules below.
QUESTION_CRITERIA = ("workload", "market_fit", "exam", "language")
IMPROVEMENT_CHECKERS = ("curriculum_relevance_checker", "model_rubric_checker")
IMPROVEMENT_TYPES = ("missing_key_topic", "topic_review", "outdated_approach", "language_tooling_conflict")
MODEL_CHECKERS = ("curriculum_relevance_checker", "dependency_freshness_checker", "fact_checker_perplexity", "model_rubric_checker", "readability_checker", "rights_originality_checker", "spelling_wording_checker", "tech_freshness_checker")
GENERIC_DETAILS = ("Проверка актуальности без отдельного пояснения.", "Фактологическая проверка без отдельного пояснения.", "Модельная проверка без отдельного источника.")
TOOL_TITLES = ("Внешняя проверка", "Модельная проверка")
TOOL_ERROR = "ошибка проверки"
UNCHECKED = ("", "неизвестно", "unknown", "не проверялось")
NO_BRANCH = "без ветки"
HIGH_PRECISION_CHECKERS = ("broken_url_syntax_checker", "label_punctuation_checker", "local_consistency_checker", "markdown_structure_checker", "checklist_checker", "cross_file_consistency_checker", "course_material_relevance_checker", "curriculum_relevance_checker", "link_checker", "local_link_checker")
LANGUAGE_SUFFIX = r"(?i)([_-](?:rus|ru|eng|en|uzb|uz))(?=\.[^.\\/]+$)"


def issue_kind() -> Column:
    given = F.col("extra")["issue_kind"]
    return (
        F.when(given.isin("defect", "improvement", "question", "unknown"), given)
        .when(F.col("verdict") == "unknown", "question")
        .when(F.col("criterion").isin(*QUESTION_CRITERIA), "question")
        .when(F.col("checker_name").isin(*IMPROVEMENT_CHECKERS) & F.coalesce(F.col("issue_type"), F.lit("")).isin(*IMPROVEMENT_TYPES), "improvement")
        .otherwise("defect")
    )


def legacy_id() -> Column:
    """The id of the older reports. It leaves out the issue type, so it isn't unique; finding_key is."""
    line = F.when(F.col("file_path").isNull(), "").otherwise(F.coalesce(F.col("line_start").cast("string"), F.lit("None")))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.concat_ws("|", "unit_id", "checker_name", "criterion", "issue_kind", "severity", empty("quote"), empty("file_path"), line)
    return F.concat(F.lit("fnd_"), F.substring(F.sha1(raw), 1, 12))


def findings(rows: DataFrame) -> DataFrame:
    """rows with any of the finding columns -> all of them; missing ones are null, ids and issue_kind are computed. `ordinal` stays."""
    def absent(name: str, kind: str) -> Column:
        return F.create_map().cast(kind) if name == "extra" else F.array().cast(kind) if name == "evidence" else F.lit(None).cast(kind)

    missing = {name: absent(name, kind) for name, kind in FINDING_COLUMNS.items() if name not in rows.columns}
    if "extra" in rows.columns:
        missing["extra"] = F.coalesce("extra", F.create_map().cast(FINDING_COLUMNS["extra"]))
    rows = rows.withColumns(missing).withColumn("issue_kind", issue_kind()).withColumn("legacy_finding_id", legacy_id())
    rows = rows.withColumn("finding_key", F.concat_ws(":", "legacy_finding_id", F.coalesce("issue_type", F.lit(""))))
    return rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in FINDING_COLUMNS.items()), *(c for c in ("ordinal",) if c in rows.columns))


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All checkers' findings; equal ones stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def details(joiner: str = " ") -> Column:
    return F.array_join(F.filter(F.transform("evidence", lambda e: squeeze(F.coalesce(e["detail"], F.lit("")))), lambda d: d != ""), joiner)


def calibrated(rows: DataFrame) -> DataFrame:
    """Severity policy: workload, and market fit without a source or 80 characters of evidence, are advisory; market fit is major at most."""
    specific = (F.coalesce(F.col("source"), F.lit("")) != "") | (F.char_length(details()) >= 80)
    advisory = (F.col("criterion") == "workload") | ((F.col("criterion") == "market_fit") & ~specific)
    severity = F.when(advisory, "info").when((F.col("criterion") == "market_fit") & (F.col("severity") == "critical"), "major").otherwise(F.col("severity"))
    verdict = F.when(advisory & F.col("verdict").isin("fail", "warning"), "unknown").otherwise(F.col("verdict"))
    changed = (severity != F.col("severity")) | (verdict != F.col("verdict"))
    original = F.create_map(F.lit("original_severity"), F.col("severity"), F.lit("original_verdict"), F.col("verdict"), F.lit("severity_calibration"), F.lit("policy"))
    extra = F.when(changed, F.map_concat(F.map_filter(original, lambda k, _: ~F.array_contains(F.map_keys("extra"), k)), "extra")).otherwise(F.col("extra"))
    return rows.withColumns({"severity": severity, "verdict": verdict, "extra": extra})


def is_tool_error() -> Column:
    text = F.concat_ws(" ", F.transform("evidence", lambda e: e["detail"]))
    titled = F.exists("evidence", lambda e: e["title"].isin(*TOOL_TITLES))
    broken = text.contains("OpenRouter") | text.contains("HTTP ") | F.lower(text).contains("ошибк")
    return F.coalesce(F.col("support_status") == TOOL_ERROR, F.lit(False)) | (titled & broken)


def _bare() -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return empty("source") & empty("latest_version") & empty("recommended_version")


def is_empty_model_result() -> Column:
    ours = F.col("checker_name").isin(*MODEL_CHECKERS) | (F.coalesce("prompt_version", F.lit("")) != "")
    said = F.filter(F.transform("evidence", lambda e: squeeze(F.coalesce(e["detail"], F.lit("")))), lambda d: d != "")
    return ours & (F.col("verdict") == "unknown") & (F.col("confidence") <= 0) & _bare() & F.forall(said, lambda d: d.isin(*GENERIC_DETAILS))


def is_low_evidence() -> Column:
    status = F.lower(F.trim(F.coalesce("support_status", F.lit(""))))
    ours = (F.col("checker_name") == "tech_freshness_checker") & (F.col("criterion") == "technology_freshness")
    return ours & (F.col("verdict") == "unknown") & (F.col("confidence") < 0.3) & _bare() & status.isin(*UNCHECKED)


def drop_reason() -> Column:
    """Why a finding leaves the report; null if it stays. The first reason counts."""
    rubric = (F.col("checker_name") == "model_rubric_checker") & (F.col("criterion") == "rights")
    return F.when(is_tool_error(), "tool_error").when(is_empty_model_result(), "empty_model_result").when(is_low_evidence(), "low_evidence").when(rubric, "rights_duplicate")


def normalized(rows: DataFrame) -> DataFrame:
    """fail is at least minor, pass is info; review for unknown verdicts, confidence below 0.7 and the rubric."""
    severity = F.when((F.col("verdict") == "fail") & (F.col("severity") == "info"), "minor").when(F.col("verdict") == "pass", "info").otherwise(F.col("severity"))
    review = (F.col("verdict") == "unknown") | (F.col("confidence") < 0.7) | (F.col("checker_name") == "model_rubric_checker")
    return rows.withColumns({"severity": severity, "needs_human_review": review})


def base_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), LANGUAGE_SUFFIX, "")


def signature() -> Column:
    norm = lambda c: F.lower(squeeze(c))
    named = F.coalesce(*(F.when(F.coalesce(F.col("extra")[k], F.lit("")) != "", F.concat(F.lit(f"{k}:"), norm(F.col("extra")[k]))) for k in ("candidate", "claim", "kind", "ecosystem")))
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat(F.coalesce(e["title"], F.lit("")), F.lit(":"), F.coalesce(e["detail"], F.lit("")))), " ")
    return F.coalesce(named, F.substring(norm(F.concat(evidence, F.lit(" "), F.coalesce("recommendation", F.lit("")))), 1, 240))


def collapsed(rows: DataFrame) -> DataFrame:
    """One row for the same case in language variants of a file: the most severe, then most confident; extra.affected_files names all.

    rows need an order among ties: `ordinal`, or else finding_key. Rows without a file pass through.
    """
    order = "ordinal" if "ordinal" in rows.columns else "finding_key"
    x = rows.withColumn("_base", base_path(F.col("file_path"))).withColumn("_sig", signature())
    keys = [F.col("unit_id"), F.coalesce("branch", F.lit("")), F.col("criterion"), F.col("checker_name"), F.col("verdict"), F.col("severity"), F.col("_base"), F.col("_sig")]
    located = F.coalesce(F.col("file_path"), F.lit("")) != ""
    group = W.partitionBy(*keys)
    first = group.orderBy(severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), (F.col("verdict") != "unknown").desc(), F.col(order))
    named = x.where(located).withColumn("_paths", F.array_sort(F.collect_set("file_path").over(group))).withColumn("_rows", F.count(F.lit(1)).over(group))
    named = named.withColumn("_n", F.row_number().over(first)).where((F.size("_paths") == 1) | (F.col("_n") == 1))
    merged = F.size("_paths") > 1
    added = F.create_map(F.lit("merged_language_duplicates"), (F.col("_rows") - 1).cast("string"), F.lit("affected_files"), F.array_join("_paths", ", "))
    named = named.withColumn("extra", F.when(merged, F.map_concat(F.map_filter("extra", lambda k, _: ~k.isin("merged_language_duplicates", "affected_files")), added)).otherwise(F.col("extra")))
    more = F.array(F.struct(F.lit("language variants").alias("title"), F.array_join("_paths", ", ").alias("detail"), F.lit(None).cast("string").alias("url")))
    named = named.withColumn("evidence", F.when(merged, F.concat("evidence", more)).otherwise(F.col("evidence")).cast(EVIDENCE))
    return named.select(*rows.columns).unionByName(x.where(~located).select(*rows.columns))


def postprocessed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that stay, those that left with drop_reason)."""
    marked = rows.withColumn("drop_reason", drop_reason())
    return collapsed(normalized(marked.where("drop_reason is null").drop("drop_reason"))), marked.where("drop_reason is not null")


def warnings(dropped: DataFrame) -> DataFrame:
    """drop_reason, n, examples (the first three details by finding_key)."""
    detail = F.substring(F.coalesce(F.get("evidence", F.lit(0))["detail"], F.col("recommendation"), F.lit("")), 1, 240)
    few = F.slice(F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.struct("_n", "_d")))), 1, 3)
    x = dropped.withColumn("_n", F.row_number().over(W.partitionBy("drop_reason").orderBy("finding_key"))).withColumn("_d", detail)
    return x.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"), F.transform(few, lambda e: e["_d"]).alias("examples"))


def reported(rows: DataFrame, keep_unknown: bool = True) -> DataFrame:
    return rows.where("verdict <> 'pass'" + ("" if keep_unknown else " and verdict <> 'unknown'"))


def summary(rows: DataFrame) -> DataFrame:
    """dimension, value, n, units: totals and counts by severity, criterion, branch and unit in one pass over the findings."""
    x = rows.select("severity", "criterion", F.coalesce("branch", F.lit(NO_BRANCH)).alias("branch"), "unit_id")
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("severity", "criterion", "branch", "unit_id")))
    x = x.select("unit_id", F.explode(pairs).alias("p"))
    return x.groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit_id").alias("units"))


def tier() -> Column:
    fix = F.col("severity").isin("critical", "major") | F.col("checker_name").isin(*HIGH_PRECISION_CHECKERS)
    return F.when(fix, "fix").otherwise("review")


def triage(rows: DataFrame) -> DataFrame:
    """tier, severity, n, groups: findings and distinct (unit, criterion, issue type) of each tier; severity 'all' is the tier's total."""
    x = rows.select(tier().alias("tier"), "severity", F.struct("unit_id", "criterion", F.coalesce("issue_type", F.lit("")).alias("issue_type")).alias("g"))
    x = x.select("tier", F.explode(F.array(F.lit("all"), "severity")).alias("severity"), "g")
    return x.groupBy("tier", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("groups"))

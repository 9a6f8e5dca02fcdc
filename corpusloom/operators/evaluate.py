"""Findings against gold labels: matching, precision and recall, slices, missed cases."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import may_match, normalize_issue_text
from ..materialize import written
from .matching import greedy

# Groups of checkers, commands and words of the missing-artifact signal, counted kinds of match.
CHECKER_GROUPS = {
    "broken_url_syntax_checker": "deterministic_rules", "label_punctuation_checker": "deterministic_rules", "local_consistency_checker": "deterministic_rules", "markdown_structure_checker": "deterministic_rules",
    "spelling_wording_checker": "editorial_rules", "link_checker": "links_and_resources", "local_link_checker": "links_and_resources", "resource_availability_checker": "links_and_resources",
    "checklist_checker": "checklist_and_artifacts", "fact_checker_perplexity": "factcheck", "readme_fact_actuality_checker": "factcheck", "tech_freshness_checker": "factcheck", "dependency_freshness_checker": "factcheck",
    "curriculum_relevance_checker": "methodology", "market_fit_checker": "methodology", "model_rubric_checker": "methodology",
}
COMMANDS = ("whoami", "id", "uname", "ls", "hostname", "ifconfig", "ipconfig", "tcpdump", "tshark")
ARTIFACT = r"(?U)\b(pcap|pcapng|dump|capture|trace|log)\b|дамп|захват|артефакт"
ABSENT = r"(?U)\bнет\b|не найден|не содержит|отсутств|missing|not found|without"
COUNTED = ("line_and_text", "line_overlap", "near_line_and_text", "text_similarity", "artifact_missing_signal")


def ratio(n: Column, d: Column) -> Column:
    """n / d with four decimals, half to even; 0 if d is 0."""
    return F.when(d == 0, 0.0).otherwise(F.bround(n / F.when(d != 0, d), 4))


def f1(precision: Column, recall: Column) -> Column:
    """From the rounded precision and recall, rounded again."""
    total = precision + recall
    return F.when(total == 0, 0.0).otherwise(F.bround(2 * precision * recall / F.when(total != 0, total), 4))


def file_name_key(path: Column) -> Column:
    name = F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))
    return F.when(name.startswith("readme"), "readme").otherwise(name)


def soft_candidates(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """gold (gold_idx, unit_id, criterion, file_path, line_start) x predictions (pred_idx, ...) of equal unit and criterion -> gold_idx, pred_idx, unit_id, criterion, score > 0."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    p = predictions.select("pred_idx", "unit_id", "criterion", F.when(~empty("file_path"), file_name_key(F.col("file_path"))).alias("file_key"), F.col("line_start").alias("pred_line"))
    g = gold.select("gold_idx", "unit_id", "criterion", F.when(~empty("file_path"), file_name_key(F.col("file_path"))).alias("file_key"), F.col("line_start").alias("gold_line"))
    # a named file is part of the key; only gold rows without one meet all of their unit
    named = g.join(p, ["unit_id", "criterion", "file_key"]).withColumn("_f", F.lit(1.0))
    x = named.unionByName(g.where("file_key is null").drop("file_key").join(p, ["unit_id", "criterion"]).withColumn("_f", F.lit(0.8)))
    gap = F.abs(F.col("gold_line") - F.col("pred_line"))
    line = F.when(F.col("gold_line").isNull(), 0.8).when(F.col("pred_line").isNull(), 0.0).when(gap == 0, 1.0).when(gap <= 2, 0.75).otherwise(0.0)
    x = x.withColumn("_l", line).where("_l > 0")
    return x.select("gold_idx", "pred_idx", "unit_id", "criterion", F.bround(F.lit(0.6) + F.col("_f") * 0.2 + F.col("_l") * 0.2, 4).alias("score"))


def soft_matches(candidates: DataFrame) -> DataFrame:
    """Best score first; of equal ones the later gold row, then the later prediction."""
    return greedy(candidates, ["unit_id", "criterion"], [("score", False), ("gold_idx", False), ("pred_idx", False)])


def precision_recall(gold: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: totals, true and false positives, false negatives, precision, recall, critical_recall, false_positive_rate."""
    found = matches.select("gold_idx").distinct().withColumn("hit", F.lit(1))
    g = gold.join(found, "gold_idx", "left")
    critical = F.col("severity") == "critical"
    x = g.agg(F.count(F.lit(1)).alias("gold_total"), F.count("hit").alias("true_positive"), F.count(F.when(critical, 1)).alias("_c"), F.count(F.when(critical & F.col("hit").isNotNull(), 1)).alias("_ch"))
    x = x.crossJoin(predictions.agg(F.count(F.lit(1)).alias("predicted_total")))  # one row by one row
    x = x.withColumn("false_positive", F.col("predicted_total") - F.col("true_positive")).withColumn("false_negative", F.col("gold_total") - F.col("true_positive"))
    return x.select(
        "gold_total", "predicted_total", "true_positive", "false_positive", "false_negative",
        ratio(F.col("true_positive"), F.col("predicted_total")).alias("precision"), ratio(F.col("true_positive"), F.col("gold_total")).alias("recall"),
        ratio(F.col("_ch"), F.col("_c")).alias("critical_recall"), ratio(F.col("false_positive"), F.col("predicted_total")).alias("false_positive_rate"),
    )


def by_criterion(gold: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """criterion, gold, predicted, tp, fp, fn, precision, recall, f1; criteria of either side."""
    g = gold.groupBy("criterion").agg(F.count(F.lit(1)).alias("gold"))
    p = predictions.groupBy("criterion").agg(F.count(F.lit(1)).alias("predicted"))
    m = matches.groupBy("criterion").agg(F.count(F.lit(1)).alias("tp"))
    x = g.join(p, "criterion", "full").join(m, "criterion", "left").na.fill(0, ["gold", "predicted", "tp"])
    x = x.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("gold") - F.col("tp"))
    x = x.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro(metrics: DataFrame) -> DataFrame:
    """The mean of each rounded metric over criteria."""
    return metrics.agg(*(F.bround(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def overview(gold: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("unit_id", "criterion")) -> DataFrame:
    """status (found, extra, missed), n: distinct keys of both sides as sets."""
    g, p = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True)), predictions.select(*keys).distinct().withColumn("in_pred", F.lit(True))
    status = F.when(F.col("in_gold").isNull(), "extra").when(F.col("in_pred").isNull(), "missed").otherwise("found")
    return g.join(p, list(keys), "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def slice_precision(predictions: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """by, predicted, tp, fp, precision, fp_share (of all false positives)."""
    hit = matches.select("pred_idx").distinct().withColumn("hit", F.lit(1))
    x = predictions.join(hit, "pred_idx", "left").groupBy(by).agg(F.count(F.lit(1)).alias("predicted"), F.count("hit").alias("tp")).withColumn("fp", F.col("predicted") - F.col("tp"))
    total = F.sum("fp").over(W.partitionBy(F.lit(0)))  # a row per slice
    return x.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("fp_share", ratio(F.col("fp"), total))


def checker_group(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CHECKER_GROUPS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), F.lit("other"))


def cost_quality(usage: Column, tp: Column) -> Column:
    """Cost per true positive; null without one."""
    return F.try_divide(usage, tp)


def strict_signals(predictions: DataFrame) -> DataFrame:
    """Predictions that look like a checkable defect."""
    resource = F.coalesce("issue_type", F.lit("")).isin("missing_local_resource", "unconfirmed_environment_path")
    keep = (F.col("verdict") != "pass") & ~((F.col("verdict") == "unknown") & (F.coalesce("confidence", F.lit(0.0)) < 0.8))
    keep = keep & F.when(F.col("checker_name") == "link_checker", F.col("verdict") == "fail").when(F.col("checker_name") == "resource_availability_checker", resource).otherwise(True)
    return predictions.where(keep)


def line_relation(gs: Column, ge: Column, ps: Column, pe: Column) -> Column:
    """none, overlap, near (two lines at most) or far. A missing or zero end is the start."""
    ge, pe = F.when(F.coalesce(ge, F.lit(0)) == 0, gs).otherwise(ge), F.when(F.coalesce(pe, F.lit(0)) == 0, ps).otherwise(pe)
    gap = F.least(F.abs(gs - pe), F.abs(ps - ge))
    return F.when(gs.isNull() | ps.isNull(), "none").when((gs <= pe) & (ps <= ge), "overlap").when(gap <= 2, "near").otherwise("far")


def token_overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))


def matched_share(a: str | None, b: str | None) -> float:
    return SequenceMatcher(a=a or "", b=b or "").ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching blocks (Ratcliff and Obershelp) of two texts."""
    return pd.Series([matched_share(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Characters that are counted one by one; all others count as one more.
LETTERS = "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюя0123456789 "


def letter_counts(text: Column) -> Column:
    """How often each of LETTERS stands in a text, and how many others."""
    n = F.char_length(text)
    counts = [n - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS]
    return F.concat(F.array(*counts), F.array(n - sum(counts[1:], counts[0])))


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that the sequence ratio of two texts with these letter counts can be."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    total = F.aggregate(F.concat(a, b), F.lit(0), lambda s, x: s + x)
    return F.when(total > 0, 2.0 * both / F.when(total > 0, total)).otherwise(1.0)


def artifact_words(text: Column) -> Column:
    """The commands that a text names, if it also speaks of an artifact and something absent; two such texts with a common one are a missing-artifact signal."""

    def words(a: Column) -> Column:
        named = F.array_compact(F.array(*(F.when(a.contains(c) & a.rlike(rf"(?U)(?<![\w-]){re.escape(c)}(?![\w-])"), c) for c in COMMANDS)))
        says = may_match(a, ARTIFACT) & may_match(a, ABSENT) & a.rlike(ARTIFACT) & a.rlike(ABSENT)
        return F.when(says, named).otherwise(F.array().cast("array<string>"))

    # in a lambda, so that the normal form isn't made again for each pattern
    return F.get(F.transform(F.array(normalize_issue_text(text)), words), F.lit(0))


def missing_artifact(gold: Column, found: Column) -> Column:
    """Both speak of the same command, an artifact, and something absent."""
    return F.arrays_overlap(artifact_words(gold), artifact_words(found))


#: A text score up to this changes no score and no kind of match.
IDLE = 0.15


def text_scored(pairs: DataFrame) -> DataFrame:
    """pairs with `a` and `b` (normal forms) and their letter counts, as pairs with `text`, their score, and `verified`.

    0 if a side is empty, 0.95 if one contains the other, else the better of token overlap and sequence ratio. The ratio is
    taken once for each two texts, and only where letters allow that it beats the overlap (and IDLE): filter and verify.
    """
    a, b = F.col("a"), F.col("b")
    inside = b.contains(a) | a.contains(b)
    x = pairs.withColumn("overlap", token_overlap(a, b))
    sure = F.when((a == "") | (b == ""), 0.0).when(inside, 0.95).when(ratio_bound(F.col("letters_a"), F.col("letters_b")) <= F.greatest("overlap", F.lit(IDLE)), F.bround("overlap", 4))
    x = written(x.withColumn("sure", sure).drop("letters_a", "letters_b"))
    ratios = x.where("sure is null").select("a", "b").distinct().withColumn("ratio", sequence_ratio(a, b))
    x = x.join(written(ratios), ["a", "b"], "left")
    return x.withColumns({"text": F.coalesce("sure", F.bround(F.greatest("overlap", "ratio"), 4)), "verified": F.col("sure").isNull()}).drop("sure", "ratio", "overlap")


def pair_scores(gold_cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """gold_cases (gold_idx, project_id, criterion, gold_text, line_start, line_end) x predictions (pred_idx, ..., found_text, ...) -> match_type, score, verified.

    What belongs to one side is taken once a row, before the join.
    """
    own = lambda text, k: (normalize_issue_text(F.col(text)).alias(k), artifact_words(F.col(text)).alias(f"words_{k}"))
    p = predictions.select("pred_idx", "project_id", "criterion", *own("found_text", "b"), F.col("line_start").alias("ps"), F.col("line_end").alias("pe")).withColumn("letters_b", letter_counts(F.col("b")))
    x = gold_cases.select("gold_idx", "project_id", "criterion", *own("gold_text", "a"), F.col("line_start").alias("gs"), F.col("line_end").alias("ge")).withColumn("letters_a", letter_counts(F.col("a")))
    x = x.join(p, ["project_id", "criterion"])
    x = x.withColumns({"relation": line_relation(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe")), "absent": F.arrays_overlap("words_a", "words_b")})
    x = text_scored(x.select("gold_idx", "pred_idx", "project_id", "criterion", "a", "b", "letters_a", "letters_b", "relation", "absent"))
    relation, text = F.col("relation"), F.col("text")
    kind = (
        F.when(F.col("absent"), "artifact_missing_signal")
        .when((relation == "overlap") & (text >= 0.25), "line_and_text")
        .when(relation == "overlap", "line_overlap")
        .when((relation == "near") & (text >= 0.2), "near_line_and_text")
        .when(text >= 0.55, "text_similarity")
        .otherwise("criterion_only")
    )
    x = x.withColumn("match_type", kind)
    floor = F.coalesce(*(F.when(F.col("match_type") == k, F.lit(v)) for k, v in (("artifact_missing_signal", 0.78), ("line_and_text", 0.9), ("near_line_and_text", 0.75), ("criterion_only", IDLE))), F.lit(0.0))
    score = F.when(F.col("match_type") == "line_overlap", 0.82).otherwise(F.greatest(floor, text))
    return x.select("gold_idx", "pred_idx", "project_id", "criterion", "match_type", F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("score"), "verified")


def strict_matches(gold_cases: DataFrame, scored: DataFrame) -> DataFrame:
    """A row per gold case: its match (counted), or its best free prediction (not counted), or match_type missed."""
    counted = greedy(scored.where(F.col("match_type").isin(*COUNTED)), ["project_id", "criterion"], [("score", False), ("gold_idx", True), ("pred_idx", True)])
    counted = counted.select("gold_idx", "pred_idx", "match_type", "score", F.lit(True).alias("counted"))
    free = scored.join(counted.select("pred_idx"), "pred_idx", "left_anti").join(counted.select("gold_idx"), "gold_idx", "left_anti")
    best = W.partitionBy("gold_idx").orderBy(F.desc("score"), "pred_idx")
    miss = free.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("gold_idx", "pred_idx", "match_type", "score", F.lit(False).alias("counted"))
    out = gold_cases.select("gold_idx", "project_id", "criterion").join(counted.unionByName(miss), "gold_idx", "left")
    return out.withColumns({"match_type": F.coalesce("match_type", F.lit("missed")), "score": F.coalesce("score", F.lit(0.0)), "counted": F.coalesce("counted", F.lit(False))})


def missed_reasons(gold: DataFrame, matches: DataFrame, predictions: DataFrame, near: DataFrame) -> DataFrame:
    """gold_idx, reason for gold rows without a match: near_miss, same_criterion, other_criterion, unit_only, not_covered (the first that holds).

    near has gold_idx of rows with an uncounted candidate.
    """
    left = gold.join(matches.select("gold_idx"), "gold_idx", "left_anti")
    same = predictions.select("unit_id", "criterion").distinct().withColumn("_same", F.lit(True))
    unit = predictions.select("unit_id").distinct().withColumn("_unit", F.lit(True))
    anywhere = predictions.select("criterion").distinct().withColumn("_any", F.lit(True))
    x = left.join(near.select("gold_idx").distinct().withColumn("_near", F.lit(True)), "gold_idx", "left").join(same, ["unit_id", "criterion"], "left").join(unit, "unit_id", "left").join(anywhere, "criterion", "left")
    reason = F.when(F.col("_near"), "near_miss").when(F.col("_same"), "same_criterion").when(F.col("_unit"), "other_criterion").when(F.col("_any"), "unit_only").otherwise("not_covered")
    return x.select("gold_idx", reason.alias("reason"))


#: The tables of an evaluation.
BUNDLE = ("summary", "main", "by_criterion", "overview_by_criterion", "by_checker", "by_checker_group", "false_negative_analysis", "false_positive_detailed", "false_negative", "false_positive")


def scores(rows: DataFrame) -> DataFrame:
    """rows (..., gold_total, predicted_total, true_positive) with false_positive, false_negative, precision, recall, f1_score."""
    x = rows.na.fill(0, ["gold_total", "predicted_total", "true_positive"])
    tp, gold, predicted = (F.col(c) for c in ("true_positive", "gold_total", "predicted_total"))
    x = x.withColumns({"false_positive": predicted - tp, "false_negative": gold - tp, "precision": ratio(tp, predicted), "recall": ratio(tp, gold)})
    return x.withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def evaluation(gold_cases: DataFrame, predictions: DataFrame, scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ten tables of an evaluation (BUNDLE), all from one written table of matches and one of predictions with their hits.

    gold_cases (gold_idx, project_id, criterion, gold_text, line_start, line_end) and predictions (pred_idx, project_id,
    criterion, checker_name, found_text, line_start, line_end, ...). Predictions of criteria without gold cases are out of
    scope. scored: pair scores, if there are any already.
    """
    gold = written(gold_cases.select("gold_idx", "project_id", "criterion", "gold_text", "line_start", "line_end"))
    scope = gold.select("criterion").distinct()
    found = predictions.join(F.broadcast(scope), "criterion", "left_semi")  # a row per criterion
    found = written(found.select("pred_idx", "project_id", "criterion", "checker_name", "found_text", "line_start", "line_end").withColumn("checker_group", checker_group(F.col("checker_name"))))
    matches = written(strict_matches(gold, written(scored if scored is not None else pair_scores(gold, found))))
    hits = matches.where("counted").select("pred_idx").withColumn("hit", F.lit(1))
    found = written(found.join(hits, "pred_idx", "left"))
    main = gold.join(matches.drop("project_id", "criterion"), "gold_idx").join(found.select("pred_idx", "found_text", "checker_name", F.col("line_start").alias("found_start"), F.col("line_end").alias("found_end")), "pred_idx", "left")
    by = lambda rows, key, name: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    criteria = scores(by(gold, "criterion", "gold_total").join(by(found, "criterion", "predicted_total"), "criterion", "full").join(by(matches.where("counted"), "criterion", "true_positive"), "criterion", "left"))
    keys = ["project_id", "criterion"]
    sides = written(gold.select(*keys).distinct().withColumn("in_gold", F.lit(1)).join(predictions.select(*keys).distinct().withColumn("in_found", F.lit(1)), keys, "full"))
    overview = scores(sides.groupBy("criterion").agg(F.count("in_gold").alias("gold_total"), F.count("in_found").alias("predicted_total"), F.count(F.when(F.col("in_gold") == F.col("in_found"), 1)).alias("true_positive")))

    def sliced(key: str) -> DataFrame:
        x = found.groupBy(F.col(key).alias("slice_name")).agg(F.count(F.lit(1)).alias("predicted_total"), F.count("hit").alias("true_positive")).withColumn("false_positive", F.col("predicted_total") - F.col("true_positive"))
        total = F.sum("false_positive").over(W.partitionBy(F.lit(0)))  # a row per slice
        return x.withColumns({"precision": ratio(F.col("true_positive"), F.col("predicted_total")), "false_positive_share": ratio(F.col("false_positive"), total)})

    missed = main.where("not counted")
    in_unit = found.groupBy("project_id").agg(F.count(F.lit(1)).alias("_unit"))
    in_scope = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_same"))
    reason = F.when(F.col("match_type") != "missed", "near_miss").when(F.col("_same").isNotNull(), "same_criterion").when(F.col("_unit").isNotNull(), "other_criterion").otherwise("not_covered")
    analysis = missed.join(in_scope, keys, "left").join(in_unit, "project_id", "left").select("gold_idx", *keys, "line_start", "line_end", "gold_text", F.col("pred_idx").alias("nearest_pred_idx"), F.col("checker_name").alias("nearest_checker"), F.col("match_type").alias("nearest_match_type"), F.col("score").alias("nearest_score"), reason.alias("reason_code"))
    one = lambda rows, *aggs: rows.agg(*aggs)
    totals = one(gold, F.count(F.lit(1)).alias("gold_total")).crossJoin(one(found, F.count(F.lit(1)).alias("predicted_total"), F.count("hit").alias("true_positive")))  # one row by one row
    return {
        "summary": scores(totals).crossJoin(macro(criteria.withColumnRenamed("f1_score", "f1"))),
        "main": main,
        "by_criterion": criteria, "overview_by_criterion": overview, "by_checker": sliced("checker_name"), "by_checker_group": sliced("checker_group"), "false_negative_analysis": analysis,
        "false_positive_detailed": found.where("hit is null").drop("hit", "checker_group"), "false_negative": sides.where("in_found is null").select(*keys), "false_positive": sides.where("in_gold is null").select(*keys),
    }

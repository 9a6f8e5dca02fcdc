"""Licences, provenance and copied code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import findings
from .lines import top_n
from .similarity import ATTRIBUTION

# Licence policy, risk ladder and patterns.
DENY = ("GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")
REVIEW = ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-4.0", "LicenseRef-Custom")
DATASET = r"\b(kaggle\.com/datasets|huggingface\.co/datasets|archive\.ics\.uci\.edu|датасет|dataset)\b"
LADDER = {"violation": ("critical", "fail", True), "unlicensed": ("major", "fail", True), "no_source": ("minor", "warning", True), "no_license_only": ("info", "warning", False), "unverifiable": ("info", "unknown", True)}
LICENSE_TEXT = r"(?iu)license|лицензи"
PROJECT_LICENSE = (r"(?m)^\s*license\s*=\s*[\"']([^\"']+)", r"(?m)^\s*license\s*=\s*\{[^}\n]*(?:text|file)\s*=\s*[\"']([^\"']+)")
DECORATIVE = ("icon", "badge", "logo", "avatar", "divider", "emoji", "shields.io", "икон", "логотип")


def license_policy(spdx: Column) -> Column:
    """deny, review or allow; unknown licences are reviewed."""
    name = F.trim(spdx)
    return F.when(name.isNull(), "review").when(name.isin(*DENY), "deny").when(name.isin(*REVIEW) | name.startswith("LicenseRef-"), "review").otherwise("allow")


def guessed_license(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("mit license"), "MIT")
        .when(low.contains("apache license") & low.contains("version 2.0"), "Apache-2.0")
        .when(low.contains("gnu affero general public license"), "AGPL-3.0-or-later")
        .when(low.contains("gnu general public license"), "GPL-3.0-or-later")
    )


def graded(signals: DataFrame) -> DataFrame:
    """signals (risk, deterministic, ...) with severity, verdict, needs_human_review: what isn't deterministic is minor and unknown at most."""
    pick = lambda k: F.coalesce(*(F.when(F.col("risk") == r, F.lit(v[k])) for r, v in LADDER.items()))
    severity = F.when(~F.col("deterministic") & pick(0).isin("major", "critical"), "minor").otherwise(pick(0))
    return signals.withColumns({"severity": severity, "verdict": F.when(F.col("deterministic"), pick(1)).otherwise("unknown"), "needs_human_review": ~F.col("deterministic") | pick(2)})


def rights_findings(signals: DataFrame) -> DataFrame:
    """signals (unit_id, risk, deterministic, confidence, issue_type, ...) as findings."""
    return findings(graded(signals).withColumns({"criterion": F.lit("rights"), "checker_name": F.lit("rights_originality_checker")}))


def declared_license(name: Column, text: Column) -> Column:
    """The licence that a file of this name states: package.json or pyproject.toml by their field, LICENSE files by their words; null if none."""
    low = F.lower(name)
    package = F.from_json(text, "struct<license:string>")["license"]
    project = F.coalesce(*(F.nullif(F.regexp_extract(text, rule, 1), F.lit("")) for rule in PROJECT_LICENSE))
    stated = F.when(low == "package.json", package).when(low == "pyproject.toml", project).when(low.startswith("license"), guessed_license(text))
    return F.nullif(F.trim(stated), F.lit(""))


def units_without_license(files: DataFrame) -> DataFrame:
    """A signal for each unit that has no LICENSE or NOTICE file, whose README names no licence, and whose manifests declare none."""
    base = F.substring_index("relative_path", "/", -1)
    name = F.upper(base)
    has = (name.startswith("LICENSE") | name.startswith("NOTICE")) | ((F.col("kind") == "readme") & F.coalesce(F.col("text").rlike(LICENSE_TEXT), F.lit(False)))
    has = has | F.when(F.lower(base).isin("package.json", "pyproject.toml"), declared_license(base, F.col("text")).isNotNull()).otherwise(False)
    x = files.groupBy("unit_id").agg(F.max(has).alias("has")).where("not has")
    return rights_findings(x.select("unit_id", F.lit("no_license_only").alias("risk"), F.lit(True).alias("deterministic"), F.lit(0.6).alias("confidence"), F.lit("no_project_license").alias("issue_type")))


def dependency_licenses(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Signals for declared dependencies (unit_id, ecosystem, name, file_path) whose licence in the registry is denied or has to be reviewed."""
    x = candidates.join(registry.select("ecosystem", "name", "license_spdx"), ["ecosystem", "name"]).withColumn("policy", license_policy(F.col("license_spdx"))).where("policy <> 'allow'")
    x = x.dropDuplicates(["unit_id", "ecosystem", "name", "license_spdx"])
    deny = F.col("policy") == "deny"
    return rights_findings(
        x.select(
            "unit_id", "file_path", F.col("name").alias("quote"), F.when(deny, "violation").otherwise("unverifiable").alias("risk"), F.lit(True).alias("deterministic"),
            F.when(deny, 0.9).otherwise(0.55).alias("confidence"), F.lit("dependency_license").alias("issue_type"), F.create_map(F.lit("ecosystem"), "ecosystem").alias("extra"),
        )
    )


def attributed_near(text: Column, needle: Column, reach: int = 300) -> Column:
    """Whether a source or licence is named within `reach` code points of the first mention."""
    at = F.locate(needle, F.lower(text)) if isinstance(needle, str) else F.instr(F.lower(text), F.lower(needle))
    left = F.greatest(F.lit(1), at - reach)
    return (at > 0) & F.substring(text, left.cast("int"), (at - left + F.char_length(needle) + reach).cast("int")).rlike("(?iu)" + ATTRIBUTION)


def dataset_terms(files: DataFrame, per_unit: int = 5) -> DataFrame:
    """Signals for data sets that are mentioned without terms nearby; the first `per_unit` of a unit."""
    mention = F.regexp_extract("text", "(?iuU)" + DATASET, 0)
    x = files.withColumn("mention", mention).where("mention <> ''").where(~attributed_near(F.col("text"), F.col("mention")))
    x = top_n(x, ["unit_id"], ["relative_path"], per_unit)
    return rights_findings(x.select("unit_id", F.col("relative_path").alias("file_path"), F.col("mention").alias("quote"), F.lit("no_source").alias("risk"), F.lit(True).alias("deterministic"), F.lit(0.7).alias("confidence"), F.lit("dataset_terms").alias("issue_type")))


def image_sources(images: DataFrame, files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Signals for pictures (unit_id, file_path, line_start, value, target) that aren't decorative and have neither metadata nor a source nearby."""
    low = F.lower(F.col("value"))
    plain = F.lit(True)
    for hint in DECORATIVE:
        plain = plain & ~low.contains(hint)
    x = images.where(plain).join(files.select("unit_id", F.col("relative_path").alias("file_path"), "text"), ["unit_id", "file_path"])
    x = x.where(~attributed_near(F.col("text"), F.col("value")))
    meta = inventory.select("unit_id", F.col("relative_path").alias("target"), "width", "height", F.coalesce("author", "copyright", "license").alias("meta"), F.coalesce("has_c2pa", F.lit(False)).alias("c2pa"))
    x = x.join(meta, ["unit_id", "target"], "left").where("meta is null and not coalesce(c2pa, false)").where(~(F.coalesce(F.greatest("width", "height"), F.lit(10**6)) <= 200))
    x = top_n(x, ["unit_id", "target"], ["file_path", "line_start"], 1)
    return rights_findings(x.select("unit_id", "file_path", "line_start", F.col("value").alias("quote"), F.lit("no_source").alias("risk"), F.lit(True).alias("deterministic"), F.lit(0.65).alias("confidence"), F.lit("image_source").alias("issue_type")))


def copied_code(matches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Signals for code that is like another unit's and names no source; the similarity is the confidence."""
    x = matches.where((F.col("similarity") >= threshold) & ~F.col("attributed"))
    return rights_findings(x.select("unit_id", F.col("other_unit_id").alias("quote"), F.lit("unverifiable").alias("risk"), F.lit(True).alias("deterministic"), F.col("similarity").alias("confidence"), F.lit("code_similarity").alias("issue_type")))

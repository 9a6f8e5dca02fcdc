"""Review of false positives by stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z = 1.96
VERDICTS = ("real", "style", "wrong")


def sample_size(population: Column, margin: float, p: float = 0.5) -> Column:
    """Rows to look at for a share with 95 % confidence, corrected for a finite population."""
    if not 0 < margin < 1:
        raise ValueError("margin must lie between 0 and 1")
    n0 = Z**2 * p * (1 - p) / margin**2
    return F.when(population <= 0, F.lit(0)).otherwise(F.least(population, F.ceil(F.lit(n0) / (1 + (n0 - 1) / population)))).cast("long")


def wilson(successes: Column, total: Column) -> Column:
    """struct<p, low, high>: the share and its Wilson interval; (0, 0, 1) without trials."""
    n = F.when(total > 0, total).cast("double")
    p = successes / n
    d = 1 + Z**2 / n
    center = (p + Z**2 / (2 * n)) / d
    half = Z / d * F.sqrt(p * (1 - p) / n + Z**2 / (4 * n * n))
    return F.struct(
        F.coalesce(p, F.lit(0.0)).alias("p"),
        F.coalesce(F.greatest(F.lit(0.0), center - half), F.lit(0.0)).alias("low"),
        F.coalesce(F.least(F.lit(1.0), center + half), F.lit(1.0)).alias("high"),
    )


def issue_parts(issue: Column) -> Column:
    """struct<quote, defect, fix, subtype> of `quote | defect | fix | subtype`; the last part is a subtype if it is [a-z_]+, else 'other'."""
    parts = F.transform(F.split(F.coalesce(issue, F.lit("")), r"\|"), lambda p: F.trim(p))
    last = F.element_at(parts, -1)
    named = last.rlike("^[a-z_]+$")
    body = F.when(named, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    at = lambda i: F.coalesce(F.get(body, F.lit(i)), F.lit(""))
    fix = F.when(F.size(body) > 2, F.array_join(F.slice(body, F.lit(3), F.size(body)), " | ")).otherwise("")
    return F.struct(at(0).alias("quote"), at(1).alias("defect"), fix.alias("fix"), F.when(named, last).otherwise("other").alias("subtype"))


def location_parts(location: Column) -> Column:
    """struct<file_path, line_range>: split at the last colon."""
    has = location.contains(":")
    return F.struct(F.when(has, F.regexp_extract(location, r"(?s)^(.*):([^:]*)$", 1)).otherwise(location).alias("file_path"), F.when(has, F.substring_index(location, ":", -1)).otherwise("").alias("line_range"))


def sampling_plan(rows: DataFrame, margin: float = 0.15, census_max: int = 10, by: str = "subtype") -> DataFrame:
    """subtype, population, sample_size, mode: small strata are looked at whole."""
    x = rows.groupBy(by).agg(F.count(F.lit(1)).alias("population"))
    n = F.when(F.col("population") <= census_max, F.col("population")).otherwise(sample_size(F.col("population"), margin))
    x = x.withColumn("sample_size", n.cast("long"))
    return x.withColumn("mode", F.when(F.col("sample_size") >= F.col("population"), "census").otherwise("sample"))


def stratified_sample(rows: DataFrame, seed: int = 42, margin: float = 0.15, census_max: int = 10, by: str = "subtype", key: str = "finding_id") -> DataFrame:
    """The rows to look at: of each stratum its sample_size rows with the smallest hashes, whatever the partitions."""
    plan = sampling_plan(rows, margin, census_max, by).select(by, "sample_size")
    order = W.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key))
    return rows.join(plan, by).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("sample_size")).drop("_n", "sample_size")


def subtype_scores(population: DataFrame, sheet: DataFrame) -> DataFrame:
    """population (subtype per row), sheet (subtype, verdict) -> subtype, population, adjudicated, real, false_positive, precision, ci_low, ci_high."""
    n = population.groupBy("subtype").agg(F.count(F.lit(1)).alias("population"))
    verdict = F.lower(F.trim("verdict"))
    seen = sheet.where(verdict.isin(*VERDICTS)).groupBy(F.when(F.trim(F.coalesce("subtype", F.lit(""))) == "", "other").otherwise(F.trim("subtype")).alias("subtype")).agg(F.count(F.lit(1)).alias("adjudicated"), F.count(F.when(verdict == "real", 1)).alias("real"))
    x = n.join(seen, "subtype", "left").na.fill(0, ["adjudicated", "real"]).withColumn("w", wilson(F.col("real"), F.col("adjudicated")))
    some = F.col("adjudicated") > 0
    return x.select("subtype", "population", "adjudicated", "real", (F.col("adjudicated") - F.col("real")).alias("false_positive"), *(F.when(some, F.col(f"w.{a}")).alias(b) for a, b in (("p", "precision"), ("low", "ci_low"), ("high", "ci_high"))))


def stratified_score(scores: DataFrame, totals: tuple[int, int] | None = None) -> DataFrame:
    """One row: weighted precision, its 95 % margin (partly seen strata only), estimated false positives; null if a stratum wasn't looked at.

    totals (true, false positives of the corpus) add its precision before and after the correction.
    """
    share = F.col("population") / F.sum("population").over(W.partitionBy(F.lit(0)))  # a row per stratum
    x = scores.withColumn("w", share)
    spread = F.when(F.col("adjudicated") < F.col("population"), F.col("w") * F.col("w") * F.col("precision") * (1 - F.col("precision")) / F.when(F.col("adjudicated") > 0, F.col("adjudicated"))).otherwise(0.0)
    x = x.agg(
        F.sum("population").alias("population_total"), F.sum("adjudicated").alias("adjudicated_total"), F.count(F.when(F.col("adjudicated") == 0, 1)).alias("missing"),
        F.sum(F.col("w") * F.col("precision")).alias("_p"), F.sum(spread).alias("_v"), F.sum(F.col("population") * (1 - F.col("precision"))).alias("_fp"),
    )
    known = (F.col("missing") == 0) & (F.col("adjudicated_total") > 0)
    x = x.select("population_total", "adjudicated_total", F.when(known, F.col("_p")).alias("stratified_precision"), F.when(known, Z * F.sqrt("_v")).alias("margin_95"), F.when(known, F.col("_fp")).alias("estimated_false_positive"))
    if totals is not None:
        tp, fp = totals
        other = F.greatest(F.lit(0.0), fp - F.col("population_total"))
        corrected = other + F.col("estimated_false_positive")
        x = x.withColumn("original_precision", F.try_divide(F.lit(float(tp)), F.lit(float(tp + fp)))).withColumn("corrected_false_positive", corrected).withColumn("corrected_precision", F.try_divide(F.lit(float(tp)), tp + corrected))
    return x

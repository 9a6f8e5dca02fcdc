"""Findings as nested JSON reports, and the flat predictions that an evaluation takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

FINDING = (
    "struct<finding_id:string,unit_id:string,criterion:string,checker_name:string,severity:string,verdict:string,confidence:double,quote:string,recommendation:string,"
    "location:struct<file_path:string,line_start:int,line_end:int>,evidence:array<struct<title:string,detail:string,url:string>>,extra:map<string,string>>"
)
REPORT = f"struct<units:array<struct<unit_id:string,name:string>>,findings:array<{FINDING}>>"


def found_text(quote: Column, evidence: Column, recommendation: Column, issue_type: Column) -> Column:
    """Quote, the details of the first two pieces of evidence, recommendation and issue type, those that say something."""
    details = F.transform(F.slice(F.coalesce(evidence, F.array().cast("array<struct<title:string,detail:string,url:string>>")), 1, 2), lambda e: e["detail"])
    said = F.concat(F.array(quote), details, F.array(recommendation, issue_type))
    return F.array_join(F.filter(F.transform(said, lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != ""), " | ")


def predictions(reports: DataFrame, report: str = "report") -> DataFrame:
    """reports (report_no long, report: JSON) -> a row per finding of a unit that its report lists.

    pred_idx is report_no * 2**32 + the finding's place, so that ties go by report and place. Reports that can't be read, or
    have no units or findings, give no rows; a finding whose unit isn't in its report is left out. Nothing is shuffled.
    """
    x = reports.select("report_no", F.from_json(report, REPORT).alias("r"))
    names = F.map_from_entries(F.array_distinct(F.transform("r.units", lambda u: F.struct(u["unit_id"], u["name"]))))
    x = x.select("report_no", F.map_filter(names, lambda k, v: k.isNotNull()).alias("names"), F.posexplode("r.findings").alias("n", "f")).where("map_contains_key(names, f.unit_id)")
    issue = F.coalesce(F.try_element_at("f.extra", F.lit("issue_type")), F.lit(""))
    return x.select(
        (F.col("report_no") * F.lit(1 << 32) + F.col("n")).alias("pred_idx"), "f.finding_id", F.col("f.unit_id").alias("project_id"), F.col("f.unit_id").alias("unit_id"), F.try_element_at("names", F.col("f.unit_id")).alias("project"), "f.criterion", "f.checker_name",
        "f.location.line_start", "f.location.line_end", "f.location.file_path", "f.severity", "f.verdict", "f.confidence", issue.alias("issue_type"),
        found_text(F.col("f.quote"), F.col("f.evidence"), F.col("f.recommendation"), issue).alias("found_text"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports below a path, one JSON document a file, numbered by their paths."""
    from pyspark.sql import Window as W

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.input_file_name().alias("path"))
    number = files.select("path").distinct().withColumn("report_no", F.row_number().over(W.orderBy("path")).cast("long"))  # a row per file
    return files.join(number, "path").select("report_no", F.col("value").alias("report"))

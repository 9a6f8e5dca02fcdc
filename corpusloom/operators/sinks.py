"""Reports: rows as people read them, and where they are written."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import squeeze
from .findings import summary, tier

REPORT = ("finding_key", "unit_id", "unit_name", "branch", "tier", "criterion", "issue_kind", "severity", "verdict", "confidence", "fragment", "location", "explanation", "source", "checked_at", "support_status", "latest_version", "recommended_version", "needs_human_review", "checker_name", "issue_type")


def location(path: str = "file_path", start: str = "line_start", end: str = "line_end") -> Column:
    span = F.when(F.col(end).isNull() | (F.col(end) == F.col(start)), F.col(start).cast("string")).otherwise(F.concat(F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string")))
    return F.when(F.col(path).isNull(), "").otherwise(F.concat(F.col(path), F.coalesce(F.concat(F.lit(":"), span), F.lit(""))))


def fragment() -> Column:
    """The quote, with Markdown pictures and links as words, if it says something (8 characters, not just a link); else the place."""
    text = F.regexp_replace(F.coalesce("quote", F.lit("")), r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", "$2")
    text = squeeze(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"))
    useful = (F.char_length(text) >= 8) & ~text.rlike(r"^https?://\S+$")
    return F.when(useful, text).otherwise(location())


def trimmed(text: Column, limit: int = 1000) -> Column:
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def explanation() -> Column:
    """The distinct details of the evidence, then the recommendation."""
    said = F.array_distinct(F.filter(F.transform("evidence", lambda e: squeeze(F.coalesce(e["detail"], F.lit("")))), lambda d: d != ""))
    more = squeeze(F.coalesce("recommendation", F.lit("")))
    return trimmed(F.array_join(F.array_distinct(F.filter(F.concat(said, F.array(more)), lambda d: d != "")), " "))


def report_rows(findings: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """The report's columns, as text; rows that passed aren't reported."""
    x = findings.where("verdict <> 'pass'")
    if units is not None:
        x = x.join(units.select("unit_id", F.col("name").alias("unit_name")), "unit_id", "left")
    else:
        x = x.withColumn("unit_name", F.col("unit_id"))
    x = x.withColumns({"tier": tier(), "confidence": F.format_string("%.2f", "confidence"), "fragment": fragment(), "location": location(), "explanation": explanation()})
    return x.select(*REPORT)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for formats that have none."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))


class Bundle:
    """Several tables below one path that become visible together, or not at all.

    Each write puts its tables into a folder of its own, and then a manifest with the next number beside the earlier ones, by
    one rename. Readers take the manifest with the highest number. So what a broken write leaves is never read, the tables of
    two writes never mix, and of two writes at once one fails at its rename. Paths may be in any store that Spark reaches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, below: str):
        return self._hadoop.Path(f"{self.path}/{below}".rstrip("/"))

    def versions(self) -> list[int]:
        folder = self._at("_manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def write(self, tables: dict[str, DataFrame], form: str = "csv") -> int:
        """Writes all tables and commits them; returns the number of the commit. form: csv, json or parquet."""
        after, folder = max(self.versions(), default=0) + 1, f"_data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            (flat(df) if form == "csv" else df).write.option("header", form == "csv").format(form).save(f"{self.path}/{folder}/{name}")
        manifest = {"form": form, "tables": {n: {"path": f"{folder}/{n}", "schema": (flat(d) if form == "csv" else d).schema.json()} for n, d in tables.items()}}
        draft, final = self._at(f"{folder}/manifest.json"), self._at(f"_manifests/{after:08d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another write has committed number {after} below {self.path}")
        return after

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a commit, the last one if none is given."""
        known = self.versions()
        version = version if version is not None else max(known, default=None)
        if version not in known:
            raise FileNotFoundError(f"no commit {version or ''} below {self.path}")
        text = self.spark.read.text(f"{self.path}/_manifests/{version:08d}.json", wholetext=True).first()[0]
        manifest = json.loads(text)
        read = lambda t: self.spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).option("header", manifest["form"] == "csv").format(manifest["form"]).load(f"{self.path}/{t['path']}")
        return {name: read(t) for name, t in manifest["tables"].items()}


def run_totals(findings: DataFrame, units: DataFrame, files: DataFrame) -> DataFrame:
    """One row: units, files and findings in all, and units with findings; rows that passed don't count."""
    own = findings.where("verdict <> 'pass'")
    x = own.agg(F.count(F.lit(1)).alias("findings_total"), F.count_distinct("unit_id").alias("affected_units_total"))
    for table, name in ((units, "units_total"), (files, "files_total")):
        x = x.crossJoin(table.agg(F.count(F.lit(1)).alias(name)))  # one row by one row
    return x.select("units_total", "files_total", "findings_total", "affected_units_total")


def write_report(findings: DataFrame, path: str, units: DataFrame | None = None, files: DataFrame | None = None) -> int:
    """The report as people read it, the findings in full, and the summary: counts by dimension, and totals if units and files are given. One commit."""
    own = findings.where("verdict <> 'pass'")
    tables = {"report": report_rows(findings, units), "findings": own, "summary": summary(own)}
    if units is not None and files is not None:
        tables["totals"] = run_totals(findings, units, files)
    return Bundle(findings.sparkSession, path).write(tables, "json")


def adjudication_sheet(sample: DataFrame) -> DataFrame:
    """The sample with empty columns for a reviewer's verdict and note."""
    return sample.withColumns({"verdict": F.lit(""), "note": F.lit("")})

"""Views over the tables of a data directory, in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once
from ..operators.findings import findings
from ..ship import ship

#: What SQL trims of a text's ends: Unicode's separators of words, and no tab or line end.
SQL_SPACES = "".join(map(chr, [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as README files of their source: unit_id, relative_path, kind, text, size_bytes, doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("README_"), F.upper("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(F.col("source").alias("unit_id"), path.alias("relative_path"), F.lit("readme").alias("kind"), "text", F.octet_length("text").cast("long").alias("size_bytes"), "doc_id")


def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page a Markdown file: its h1 as a heading (line 0), all its list items as numbered lines; lines (unit_id: the host, relative_path: the page_id, kind, page_id, line_no, line).

    A page opens with its heading, so no list runs on into the next page and nothing has to be sorted over a host.
    """
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    title = F.concat(F.lit("# "), F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1))
    items = F.transform(F.regexp_extract_all("html", F.lit(r"<li><a[^>]*>([^<]*)</a></li>"), F.lit(1)), lambda x, i: F.concat((i + 1 - F.when(F.col("page_id") % 3 == 0, i).otherwise(F.when(i >= 3, F.lit(1)).otherwise(0))).cast("string"), F.when(F.col("page_id") % 3 == 0, ") ").otherwise(". "), x))
    body = F.posexplode(F.concat(F.array(title), items)).alias("line_no", "line")
    return pages.select(host.alias("unit_id"), F.col("page_id").cast("string").alias("relative_path"), F.lit("readme").alias("kind"), "page_id", body)


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its h1 as a heading of its host: unit_id, relative_path, line_no (page_id * 1000), title, low (the title in lower case); pages without one go.

    A title stays as it stands there: it isn't Markdown, so a # at its end, ` and [ ]( ) are no markup. Spaces and lower
    case are SQL's: spaces are ASCII inside a title, and a letter's lower case is one letter that doesn't hang on its neighbours.
    """
    pages = table(spark, sf_dir, "pages")
    h1 = F.btrim(F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1), F.lit(SQL_SPACES))
    x = once(pages.select("page_id", "url", "html"), h1=h1).where("h1 <> ''").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("unit_id"), F.regexp_replace("h1", r"[\t\n\f\r ]+", " ").alias("title"))
    return x.select("unit_id", F.lit("README.md").alias("relative_path"), (F.col("page_id") * 1000).alias("line_no"), "title", F.lower(F.translate("title", "İΣ", "iσ")).alias("low"))


# Expressions that both engines read alike: findings made of events, by remainders of event_id.
FINDING_EXPRESSIONS = {
    "ordinal": "event_id",
    "unit_id": "cast(user_id as string)",
    "branch": "case when user_id % 5 = 0 then null else concat('branch', cast(user_id % 5 as string)) end",
    "criterion": "case event_id % 13 when 0 then 'actuality' when 1 then 'links' when 2 then 'technology_freshness' when 3 then 'facts' when 4 then 'correctness' when 5 then 'readability' when 6 then 'checklist_alignment' when 7 then 'image_quality' when 8 then 'market_fit' when 9 then 'workload' when 10 then 'rights' when 11 then 'language' else 'readability' end",
    "severity": "case event_id % 7 when 0 then 'critical' when 1 then 'major' when 2 then 'major' when 3 then 'minor' when 4 then 'minor' else 'info' end",
    "verdict": "case event_id % 11 when 0 then 'pass' when 1 then 'fail' when 2 then 'fail' when 3 then 'fail' when 4 then 'unknown' when 5 then 'unknown' else 'warning' end",
    "confidence": "case when event_id % 23 = 4 then cast(0 as double) else least(cast(1 as double), value / 100) end",
    "checker_name": "case event_id % 10 when 0 then 'link_checker' when 1 then 'markdown_structure_checker' when 2 then 'model_rubric_checker' when 3 then 'tech_freshness_checker' when 4 then 'readability_checker' when 5 then 'resource_availability_checker' when 6 then 'spelling_wording_checker' when 7 then 'local_consistency_checker' when 8 then 'market_fit_checker' else 'other_checker' end",
    "file_path": "case event_id % 8 when 0 then 'README.md' when 1 then 'README_RUS.md' when 2 then 'README_ENG.md' when 3 then 'materials/part_ru.md' when 4 then 'materials/part.md' when 5 then 'check-list.yml' when 6 then 'check-list_RUS.yml' else null end",
    "line_start": "case when event_id % 9 = 0 then null else cast(event_id % 200 as int) end",
    "issue_type": "case event_id % 6 when 0 then 'typo' when 1 then 'wording' when 2 then 'missing_local_resource' when 3 then 'duplicate_heading' when 4 then 'case' else null end",
    "source": "case when event_id % 3 = 0 then 'https://example.org/source' else null end",
    "support_status": "case when event_id % 41 = 0 then 'ошибка проверки' else null end",
    "detail": "props",
    "kind": "event_type",
    "checked_at": "ts",
}


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of the events table, with their ordinal."""
    x = table(spark, sf_dir, "events").selectExpr(*(f"{e} as {n}" for n, e in FINDING_EXPRESSIONS.items()))
    evidence = F.array(F.struct(F.lit("event").alias("title"), F.col("detail"), F.lit(None).cast("string").alias("url")))
    return findings(x.withColumn("evidence", evidence).withColumn("extra", F.create_map(F.lit("kind"), "kind")).withColumn("line_end", F.col("line_start")))


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as predictions of an evaluation."""
    x = event_findings(spark, sf_dir)
    text = F.concat_ws(" | ", F.element_at("extra", "kind"), F.get("evidence", F.lit(0))["detail"], "issue_type")
    return x.select(F.col("ordinal").alias("pred_idx"), F.col("unit_id").alias("project_id"), "unit_id", "criterion", "checker_name", "file_path", "severity", "verdict", "issue_type", "confidence", "line_start", "line_end", text.alias("found_text"))


def label_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows made of labels: a document of low quality is a readability case at a line, a toxic one a fact case without a line."""
    x = table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1").selectExpr("doc_id as gold_idx", "cast(doc_id as string) as unit_id", "case when quality = 0 then 'readability' else 'facts' end as criterion", "case when toxic = 1 then 'critical' else 'minor' end as severity", "'README.md' as file_path", "case when quality = 0 then cast(doc_id % 4 + 1 as int) else null end as line_start")
    return x


def long_line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions made of documents: each line of over 260 characters (the first 8 of a document) is a readability case, each line that names a licence a fact case."""
    from ..operators.lines import lines
    from ..operators.readability import long_lines

    docs = files(spark, sf_dir).withColumn("unit_id", F.col("doc_id").cast("string")).withColumn("relative_path", F.lit("README.md"))
    long = long_lines(lines(docs)).select("unit_id", F.lit("readability").alias("criterion"), F.lit("long_line_checker").alias("checker_name"), "line_no")
    # only texts that hold the word are split into lines
    licence = lines(docs.where(F.lower("text").contains("license"))).where(F.lower("line").contains("license")).select("unit_id", F.lit("facts").alias("criterion"), F.lit("license_line_checker").alias("checker_name"), "line_no")
    x = long.unionByName(licence)
    key = F.concat_ws(":", "unit_id", "criterion", F.col("line_no").cast("string"))
    return x.select(key.alias("pred_idx"), "unit_id", "criterion", "checker_name", F.lit("readme_rus.md").alias("file_path"), F.col("line_no").alias("line_start"))

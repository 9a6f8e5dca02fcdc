"""What a unit's instructions need and whether it is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_matches, folded, may_match, once, pattern, strip
from .findings import findings
from .lines import first_in

# Kinds of files and the words that ask for or announce them.
EXTENSIONS = "pcapng pcap csv tsv xlsx xls parquet json xml sql dump bak zip rar 7z tar gz tgz xz bz2 ova ovf vmdk qcow2 img iso png jpg jpeg svg pdf".split()
ENVIRONMENT = tuple("ova ovf vmdk qcow2 img iso zip rar 7z".split())
KINDS = {
    "dataset": tuple("csv tsv xlsx xls parquet json xml".split()),
    "dump": tuple("dump sql bak pcapng pcap".split()),
    "archive": tuple("zip rar 7z tar gz tgz xz bz2".split()),
    "image": tuple("png jpg jpeg svg".split()),
    "vm": tuple("ova ovf vmdk qcow2 img iso".split()),
    "pcap": ("pcapng", "pcap"),
}
FILE_REF = rf"`([^`\n]+\.(?:{'|'.join(EXTENSIONS)}))`|(?<![\w./-])([\w./\\-]+\.(?:{'|'.join(EXTENSIONS)}))\b"
ENVIRONMENT_PATH = r"(?<![\w/])/(?:opt|mnt|srv|var|home)/[A-Za-z0-9._/-]+"
GUIDE = r"\b(?:virtualbox|vbox|vm|virtual\s+machine)\b|(?:виртуальн\w*|вм|машин\w*|образ\w*)"
URL = r"https?://\S+"
EXTERNAL = (
    r"\b(attached|downloadable|external)\s+(?:file|dataset|archive|resource)\b|"
    r"(\bприкрепл\w*\b|\bприложенн\w*\b|\bвложенн\w*\b|\bданн(?:ый|ые)?\s+файл|\bвнешн\w*\s+файл|\bфайл\s+по\s+ссылк)"
)
REQUIRED = (
    r"\b(provided|attached|given|contains|included|download|load|open|analy[sz]e|dataset|dump|archive|capture|image|picture|virtual\s+machine|vm|iso|pcap)\b|"
    r"(\bприлож\w*\b|\bвложен\w*\b|данн(?:ый|ые)?\s+файл|\bсодерж\w*\b|\bскача\w*\b|\bзагруз\w*\b|\bоткр\w*\b|\bпроанализ\w*\b|\bдатасет\w*\b|набор\s+данных|"
    r"\bдамп\w*\b|\bархив\w*\b|виртуальн\w*|машин\w*|\bкартин\w*\b|\bизображ\w*\b|\bpcap\b|\bснимок\b|\bзахват(?:а|ом)?\b)"
)
GENERIC = (
    r"\b(dataset|dump|archive|image|picture|virtual\s+machine|vm|pcap|capture)\b|"
    r"(\bдатасет\w*\b|набор\s+данных|\bдамп\w*\b|\bархив\w*\b|виртуальн(?:ая|ой)?\s+машин|\bкартин\w*\b|\bизображ\w*\b|\bpcap\b|\bзахват(?:а|ом)?\b)"
)
OUTPUT = r"\b(save|write|create|generate|export|return|output|result|turn\s+in|submit)\b|(сохран|созда|сгенер|экспорт|верн|вывед|результат|сда(?:ть|й)|положи)"


def _made(x: DataFrame, issue: str, verdict: str, confidence: float) -> DataFrame:
    line = F.col("line_no") if "line_no" in x.columns else F.lit(None).cast("int")
    return findings(
        x.select(
            "unit_id", F.col("relative_path").alias("file_path"), line.alias("line_start"), line.alias("line_end"), "quote",
            F.lit("correctness").alias("criterion"), F.lit("major").alias("severity"), F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"),
            F.lit("resource_availability_checker").alias("checker_name"), F.lit(issue).alias("issue_type"), F.lit(True).alias("needs_human_review"),
        )
    )


def structure(paths: DataFrame) -> DataFrame:
    """Findings for units (unit_id, relative_path of files) without README*.md or check-list*.y(a)ml at their root."""
    low = F.lower("relative_path")
    x = paths.groupBy("unit_id").agg(F.max(low.rlike(r"^readme.*\.md$")).alias("readme"), F.max(low.rlike(r"^check-list.*\.ya?ml$")).alias("checklist"))
    missing = F.filter(
        F.array(F.when(~F.col("readme"), F.struct(F.lit("readability").alias("criterion"), F.lit("missing_readme").alias("issue_type"))), F.when(~F.col("checklist"), F.struct(F.lit("checklist_alignment").alias("criterion"), F.lit("missing_checklist").alias("issue_type")))),
        lambda m: m.isNotNull(),
    )
    x = x.select("unit_id", F.explode(missing).alias("m")).select("unit_id", "m.*")
    return findings(x.select("*", F.lit("major").alias("severity"), F.lit("fail").alias("verdict"), F.lit(0.95).alias("confidence"), F.lit("structure_checker").alias("checker_name"), F.lit(True).alias("needs_human_review")))


def file_refs(line: Column) -> Column:
    """The resource files that a line names, in order, each once."""
    rule = pattern(FILE_REF, True)
    refs = F.zip_with(F.regexp_extract_all(line, F.lit(rule), F.lit(1)), F.regexp_extract_all(line, F.lit(rule), F.lit(2)), lambda a, b: F.regexp_replace(strip(F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)), r"^[.,;)]+|[.,;)]+$", ""))
    return F.array_distinct(F.filter(refs, lambda r: F.coalesce(r, F.lit("")) != ""))


def _key(ref: Column) -> Column:
    return F.lower(F.replace(strip(ref), F.lit("\\"), F.lit("/")))


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _last_place(text: Column, rule: str) -> Column:
    return F.coalesce(F.try_element_at(F.transform(all_matches(text, pattern(rule, True)), lambda m: m["start"]), F.lit(-1)), F.lit(-1))


def is_output(line: Column, ref: Column) -> Column:
    """Whether the words before a name say that it is made by the reader, later than that it is given."""
    low, name = F.lower(line), F.lower(ref)
    at = F.instr(low, name) - 1
    at = F.when(at >= 0, at).otherwise(F.instr(low, _base(name)) - 1)
    begin = F.greatest(F.lit(0), at - 120)
    before = F.substring(low, begin + 1, at - begin)
    after = F.substring(low, at + 1, F.char_length(name) + 80)
    made, given = _last_place(before, OUTPUT), _last_place(before, REQUIRED)
    return (at >= 0) & (made >= 0) & (made >= given) & ~after.contains("expected") & ~after.contains("ожида")


def missing_resources(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings for named inputs that the unit doesn't have, by path or by name, and that no line gives from outside."""
    x = once(lines, low=folded(F.col("line"))).where(may_match(F.col("low"), FILE_REF)).drop("low")
    x = once(x, text=strip(F.col("line"))).withColumn("ref", F.explode(file_refs(F.col("text"))))
    linked = F.col("text").rlike("(?i)" + URL)
    readme = (F.col("kind") == "readme") | F.lower(_base(F.col("relative_path"))).startswith("readme")
    x = x.withColumn("key", _key(F.col("ref"))).withColumn("base", _base(F.col("key")))
    given = x.where(linked | (readme & F.col("text").rlike(pattern(EXTERNAL, True)))).select("unit_id", F.explode(F.array("key", "base")).alias("name"))
    own = paths.select("unit_id", _key(F.col("relative_path")).alias("p")).select("unit_id", F.explode(F.array("p", _base(F.col("p")))).alias("name"))
    there = given.union(own).distinct()
    need = x.where(~linked & F.col("text").rlike(pattern(REQUIRED, True))).where(~is_output(F.col("text"), F.col("ref")))
    need = need.join(there.withColumnRenamed("name", "key"), ["unit_id", "key"], "left_anti").join(there.withColumnRenamed("name", "base"), ["unit_id", "base"], "left_anti")
    return _made(need.withColumn("quote", F.col("ref")), "missing_local_resource", "fail", 0.9)


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def unconfirmed_paths(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings for paths of a machine's own folders in units without an image or archive of that machine."""
    text = strip(F.col("line"))
    x = lines.where(~text.rlike("(?i)" + URL)).select("unit_id", "relative_path", "line_no", F.explode(F.regexp_extract_all(text, F.lit(pattern(ENVIRONMENT_PATH)), F.lit(0))).alias("quote")).withColumn("quote", F.regexp_replace("quote", r"[.,;)]+$", ""))
    sure = paths.where(_suffix(F.col("relative_path")).isin(*ENVIRONMENT)).select("unit_id").distinct()
    return _made(first_in(x.join(sure, "unit_id", "left_anti"), ["unit_id", "relative_path", "line_no", "quote"], ["line_no"]), "unconfirmed_environment_path", "warning", 0.82)


def resource_kind(marker: Column) -> Column:
    low = F.lower(marker)
    has = lambda *words: low.rlike("|".join(words))
    return F.when(has("pcap", "capture", "захват"), "pcap").when(has("вирту", "virtual", "образ", "^vm$"), "vm").when(has("архив", "archive"), "archive").when(has("дамп", "dump"), "dump").when(has("картин", "изображ", "image", "picture"), "image").otherwise("dataset")


def resources_without_artifact(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings for lines that need a kind of resource, name no file, link or path, and whose unit has no file of that kind."""
    text = strip(F.col("line"))
    generic = pattern(GENERIC, True)
    x = lines.withColumn("text", text).where(F.col("text").rlike(generic) & F.col("text").rlike(pattern(REQUIRED, True)))
    x = x.where(~F.col("text").rlike("(?i)" + URL) & ~F.col("text").rlike(pattern(ENVIRONMENT_PATH)) & (F.size(file_refs(F.col("text"))) == 0))
    x = x.withColumn("quote", F.regexp_extract("text", generic, 0)).withColumn("resource", resource_kind(F.col("quote")))
    kinds = F.filter(F.array(*(F.when(_suffix(F.col("relative_path")).isin(*s), F.lit(k)) for k, s in KINDS.items())), lambda k: k.isNotNull())
    there = paths.select("unit_id", F.explode(kinds).alias("resource")).distinct()
    return _made(x.join(there, ["unit_id", "resource"], "left_anti"), "resource_without_artifact", "warning", 0.78)


def guides_without_image(paths: DataFrame) -> DataFrame:
    """A finding for each unit with a guide to a virtual machine, at the first such file, but without an image of one."""
    sure = paths.where(_suffix(F.col("relative_path")).isin(*ENVIRONMENT)).select("unit_id").distinct()
    x = paths.where(_base(F.col("relative_path")).rlike(pattern(GUIDE, True))).groupBy("unit_id").agg(F.min("relative_path").alias("relative_path")).join(sure, "unit_id", "left_anti")
    return _made(x.withColumn("quote", _base(F.col("relative_path"))), "environment_guide_without_image", "warning", 0.84)

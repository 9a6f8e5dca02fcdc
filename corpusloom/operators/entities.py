"""Entities in files: links, images, versions, dates, technologies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_matches, context_around, line_number, line_number_of_end, pattern, quote_around
from .lines import first_in

# The patterns of the entity types.
LINK = r"https?://[^\s\])>\"']+"
IMAGE = r"!\[[^\]]*]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
VERSION = (
    r"\b((?:C|Java|Python|Node\.?js|Alpine|Ubuntu(?:\s+Server)?|POSIX|GCC|Bash|Docker|Docker\s+Compose|PostgreSQL|MySQL|MongoDB|Redis|Django|React|Vue|Angular|Next\.?js|"
    r"FastAPI|Flask|Spring|Kotlin|Go|Rust|TypeScript|JavaScript|PHP|Ruby|PCRE2|GNU|BusyBox)\s*(?:version|версии|версия)?\s*[vV]?\d+(?:\.\d+){0,3}|POSIX\.1-\d{4}|C\d{2})\b"
)
DATE = r"\b(?:19|20)\d{2}(?:[-./](?:0?[1-9]|1[0-2])(?:[-./](?:0?[1-9]|[12]\d|3[01]))?)?\b"
TECHNOLOGY = (
    r"\b(Java|Python|C11|POSIX|Alpine|Ubuntu|GCC|Makefile|PCRE2|regex|Docker|GitLab|GitHub|Rocket\.Chat|GigaChat|GNU|BusyBox|Bash|PostgreSQL|MySQL|MongoDB|Redis|Django|React|"
    r"Vue|Angular|Next\.?js|FastAPI|Flask|Spring|Kotlin|Go|Rust|TypeScript|JavaScript|PHP|Ruby)\b"
)
RULES = (("link", LINK), ("image", IMAGE), ("version", VERSION), ("date", DATE), ("technology", TECHNOLOGY))


def _mention(name: str, number: int):
    return lambda h: F.struct(F.lit(name).alias("entity_type"), F.lit(number).alias("type_no"), h["value"].alias("raw"), h["start"].alias("start"))


def mentions(files: DataFrame, types: tuple[str, ...] = tuple(t for t, _ in RULES)) -> DataFrame:
    """files (unit_id, relative_path, text) -> every match: entity_type, type_no, value, start, end, and the file's text.

    One pass over each text builds the matches of all types as one array; nothing is shuffled.
    """
    found = []
    for number, (name, regex) in enumerate(RULES):
        if name in types:
            hits = all_matches(F.col("text"), pattern(regex, ignore_case=name != "date"))
            found.append(F.transform(hits, _mention(name, number)))
    x = files.select("unit_id", "relative_path", "text", F.explode(F.concat(*found)).alias("m")).select("unit_id", "relative_path", "text", "m.*")
    x = x.withColumn("end", F.col("start") + F.char_length("raw"))
    value = F.when(F.col("entity_type") == "image", F.regexp_extract("raw", IMAGE, 1)).otherwise(F.regexp_replace("raw", r"[.,;:*!?]+$", ""))
    x = x.withColumn("value", value)
    return x.where((F.col("entity_type") != "link") | (F.coalesce(F.try_parse_url("value", F.lit("HOST")), F.lit("")) != ""))


def entities(files: DataFrame, types: tuple[str, ...] = tuple(t for t, _ in RULES)) -> DataFrame:
    """entity_id, unit_id, entity_type, value, quote, file_path, line_start, line_end, context; the first of each (type, lower value, file, line)."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    raw = F.concat_ws("|", "unit_id", "relative_path", "entity_type", "value", F.col("start").cast("string"))
    x = mentions(files, types).select(
        F.concat(F.lit("ent_"), F.substring(F.sha1(raw), 1, 12)).alias("entity_id"),
        "unit_id",
        "entity_type",
        "type_no",
        "value",
        quote_around(text, start, end).alias("quote"),
        F.col("relative_path").alias("file_path"),
        line_number(text, start).alias("line_start"),
        line_number_of_end(text, start, end).alias("line_end"),
        context_around(text, start, end).alias("context"),
        "start",
    )
    x = x.withColumn("_key", F.lower("value"))
    return first_in(x, ["unit_id", "entity_type", "_key", "file_path", "line_start"], ["start"]).drop("_key", "type_no", "start")

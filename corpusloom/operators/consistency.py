"""Contradictions inside a unit's own texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import pattern, strip
from .findings import findings
from .lines import FILE, along, first_in, sections

# Patterns of the rules.
ASC = r"\b(?:возрастан\w*|ascending|asc)\b"
DESC = r"\b(?:убыван\w*|descending|desc)\b"
SORT = r"\b(?:сортир\w*|отсортир\w*|sort(?:ed|ing)?|order(?:ed|ing)?)\b"
WORD_IS_SYMBOL = r"\b(?:словом\s+является\s+любой\s+(?:символ|character)|word\s+is\s+(?:any\s+)?(?:symbol|character))\b"
EMAIL = r"\bE-?mail\b"
TABLE_ROW = r"^\s*\|(.+)\|\s*$"
FIELD_LIST = r"(?:следующ(?:ие|ими)\s+пол(?:я|ями)|пол(?:я|ями)\s*:|following\s+fields|fields\s*:)"
LENGTH_RANGE = r"(\d{1,3})\s*(?:-|–|—|to|до)\s*(\d{1,3})\s*(?:lines?|строк(?:и|ах|ам)?|стр\.)"
FUNCTION = r"\b(functions?|methods?)\b|(?:функци\w*|метод\w*)"


def _facts(x: DataFrame, issue: str, confidence: float, criterion: str = "facts") -> DataFrame:
    return findings(
        x.select(
            "unit_id", F.col("relative_path").alias("file_path"), "line_start", "line_end", "quote",
            F.lit(criterion).alias("criterion"), F.lit("minor").alias("severity"), F.lit("warning").alias("verdict"), F.lit(confidence).alias("confidence"),
            F.lit("local_consistency_checker").alias("checker_name"), F.lit(issue).alias("issue_type"), F.lit(True).alias("needs_human_review"),
        )
    )


def sort_conflicts(lines: DataFrame, reach: int = 25) -> DataFrame:
    """Findings for two sort lines of one section, `reach` lines apart at most, that name opposite directions; the nearest one counts.

    The nearest later line of each direction comes from one window over the section, so no pairs are made.
    """
    x = sections(lines)
    asc, desc = F.col("line").rlike(pattern(ASC, True)), F.col("line").rlike(pattern(DESC, True))
    x = x.where((asc | desc) & F.col("line").rlike(pattern(SORT, True)))
    x = x.withColumn("direction", F.when(asc & desc, "both").when(asc, "asc").otherwise("desc")).withColumn("text", strip(F.col("line")))
    later = along(*FILE, "section").rowsBetween(1, W.unboundedFollowing)
    nearest = lambda d: F.first(F.when(F.col("direction") == d, F.struct("line_no", "text")), ignorenulls=True).over(later)
    x = x.withColumn("_asc", nearest("asc")).withColumn("_desc", nearest("desc")).where("direction <> 'both'")
    x = x.withColumn("other", F.when(F.col("direction") == "asc", F.col("_desc")).otherwise(F.col("_asc"))).where(F.col("other.line_no") - F.col("line_no") <= reach)
    quote = F.concat(F.substring("text", 1, 180), F.lit(" / "), F.substring("other.text", 1, 180))
    return _facts(x.select(*FILE, F.col("line_no").alias("line_start"), F.col("other.line_no").alias("line_end"), quote.alias("quote")), "sort_direction_conflict", 0.9)


def word_definitions(lines: DataFrame) -> DataFrame:
    regex = pattern(WORD_IS_SYMBOL, True)
    x = lines.where(F.col("line").rlike(regex))
    return _facts(x.select(*FILE, F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.regexp_extract("line", regex, 0).alias("quote")), "invalid_definition", 0.92)


def field_variants(lines: DataFrame) -> DataFrame:
    """A finding for each file with both Email and E-mail, at the last mention."""
    found = F.regexp_extract_all("line", F.lit(pattern(EMAIL, True)), F.lit(0))
    x = lines.select(*FILE, "line_no", F.posexplode(found).alias("n", "raw"))
    x = x.groupBy(*FILE).agg(F.count_distinct(F.lower("raw")).alias("forms"), F.max_by(F.struct("line_no", "raw"), F.struct("line_no", "n")).alias("last")).where("forms > 1")
    return _facts(x.select(*FILE, F.col("last.line_no").alias("line_start"), F.col("last.line_no").alias("line_end"), F.col("last.raw").alias("quote")), "field_name_variant", 0.86)


def _clean_field(c: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(c, "[*_`]+", "")), r"^[ .,:;]+|[ .,:;]+$", "")


def _field_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-zа-яё]+", "")


def table_headers(line: Column) -> Column:
    """The named cells of a table row; empty for separators and rows of fewer than two."""
    cells = F.filter(F.transform(F.split(F.regexp_extract(line, TABLE_ROW, 1), r"\|"), _clean_field), lambda c: c != "")
    return F.when(line.rlike(TABLE_ROW) & (F.size(cells) >= 2) & ~F.forall(cells, lambda c: c.rlike("^:?-{3,}:?$")), cells)


def listed_fields(line: Column) -> Column:
    """The fields that a line lists: marked ones (`a`, **a**, <a>), else the parts of its tail after a colon."""
    marked = F.concat(*(F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in ("`([^`]+)`", r"\*\*([^*]+)\*\*", "<([^>]+)>")))
    marked = F.filter(F.transform(marked, strip), lambda f: f != "")
    tail = F.when(line.contains(":"), F.expr("1")).isNotNull()
    rest = F.when(tail, F.regexp_replace(line, "^[^:]*:", "")).otherwise(line)
    plain = F.filter(F.transform(F.split(rest, r"(?U),|\s+и\s+|\s+and\s+"), _clean_field), lambda f: f.rlike(r"(?U)^[A-Za-zА-Яа-яЁё][\w -]{1,40}$"))
    fields = F.when(F.size(marked) > 0, marked).otherwise(plain)
    return F.when(line.rlike(pattern(FIELD_LIST, True)) & (F.size(fields) > 0), fields)


def table_mismatches(lines: DataFrame, reach: int = 8) -> DataFrame:
    """Findings for tables that lack fields which the nearest list in the `reach` lines before them names."""
    x = lines.withColumn("headers", table_headers(F.col("line"))).withColumn("fields", listed_fields(F.col("line")))
    x = x.withColumn("expected", F.last("fields", ignorenulls=True).over(along().rowsBetween(-reach, -1))).where("headers is not null and expected is not null")
    keys = F.transform("headers", _field_key)
    x = x.withColumn("missing", F.filter("expected", lambda f: ~F.array_contains(keys, _field_key(f)))).where(F.size("missing") > 0)
    return _facts(x.select(*FILE, F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.substring(strip(F.col("line")), 1, 260).alias("quote")), "table_description_mismatch", 0.84)


def length_conflicts(lines: DataFrame) -> DataFrame:
    """A finding for each unit whose texts give different ranges for the length of functions: the first and the first that differs."""
    regex = pattern(LENGTH_RANGE, True)
    found = F.regexp_extract_all("line", F.lit(regex), F.lit(0))
    x = lines.where(F.col("line").rlike(pattern(FUNCTION, True))).select(*FILE, "line_no", strip(F.col("line")).alias("text"), F.posexplode(found).alias("n", "hit"))
    a, b = (F.regexp_extract("hit", regex, k).cast("int") for k in (1, 2))
    x = x.withColumn("range", F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))
    order = ["relative_path", "line_no", "n"]
    w = W.partitionBy("unit_id").orderBy(*order)
    x = x.withColumn("_first", F.first(F.struct("range", "text")).over(w)).where("range <> _first.range")
    x = first_in(x, ["unit_id"], order)
    quote = F.concat(F.substring("_first.text", 1, 140), F.lit(" / "), F.substring("text", 1, 140))
    return _facts(x.select(*FILE, F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), quote.alias("quote")), "function_length_range_conflict", 0.88)

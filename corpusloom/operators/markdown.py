"""Structure of Markdown files: headings, anchors, chapters, numbered lists, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_for_match, pattern, strip
from .findings import findings
from .lines import FILE, along, first_in, without_fences

# Patterns of headings, lists, chapters and labels.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
NUMBERED = r"^(\s*)(\d+)([.)])\s+\S"
CHAPTER = r"\bchapter\s+([IVXLCDM]+)\b"
ROMAN = (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))
LABEL = (
    r"^\s*(?:[-*+]\s+|\d+[.)]\s+|[a-zа-яё][.)]\s+)?(?:>\s*)?(?:\*\*)?"
    r"(Input operation|Input right operand|Output|Example|Result)(?:\*\*)?([^\n]*)$"
)
PROSE = r"^(?:of|for|from|when|if|that|should|must|is|are|will|can|means|section|description|для|если|когда|котор|долж|явля|означ|раздел|описан)\b"
VALUE_START = ("`", ">", '"', "'", "«", "[", "{", "(", "-", "+")
NEXT_START = (">", "`", "|", "-", "*", "+", '"', "'", "«", "[", "{", "(")


def clean_heading(title: Column) -> Column:
    title = F.regexp_replace(strip(title), "`([^`]+)`", "$1")
    title = F.regexp_replace(title, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(F.regexp_replace(title, r"(?U)\s+", " "), "^[ #]+|[ #]+$", "")


def anchor(title: Column) -> Column:
    """A heading's anchor in the manner of the usual Markdown hosts."""
    kept = F.regexp_replace(strip(F.lower(title)), r"(?U)[^\p{L}\p{M}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


def headings(lines: DataFrame) -> DataFrame:
    """line_no, level, title, title_key, anchor of each heading outside code."""
    x = without_fences(lines)
    stripped = strip(F.col("line"))
    x = x.where(stripped.rlike(HEADING)).withColumn("level", F.char_length(F.regexp_extract(stripped, HEADING, 1))).withColumn("title", clean_heading(F.regexp_extract(stripped, HEADING, 2))).where("title <> ''")
    return x.select(*FILE, "line_no", "level", "title", normalize_for_match(F.col("title")).alias("title_key"), anchor(F.col("title")).alias("anchor"))


def _structure(x: DataFrame) -> DataFrame:
    return findings(
        x.select(
            "unit_id", F.col("relative_path").alias("file_path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.substring("quote", 1, 320).alias("quote"),
            F.lit("readability").alias("criterion"), F.lit("minor").alias("severity"), F.lit("warning").alias("verdict"), F.lit(0.88).alias("confidence"),
            F.lit("markdown_structure_checker").alias("checker_name"), "issue_type", F.lit(True).alias("needs_human_review"),
            F.create_map(F.lit("first_line"), F.col("first_line").cast("string")).alias("extra"),
        )
    )


def repeated(headings: DataFrame) -> DataFrame:
    """Headings whose title or anchor stood earlier in the file, a row for each of the two: line_no, quote, issue_type, first_line."""
    keys = F.inline(F.array(*(F.struct(F.lit(issue).alias("issue_type"), F.col(c).alias("_key")) for c, issue in (("title_key", "duplicate_heading"), ("anchor", "duplicate_anchor")))))
    x = headings.select(*FILE, "line_no", F.col("title").alias("quote"), keys)
    first = F.min("line_no").over(W.partitionBy(*FILE, "issue_type", "_key"))
    return x.withColumn("first_line", first).where(F.col("line_no") > F.col("first_line")).drop("_key")


def repeated_headings(lines: DataFrame) -> DataFrame:
    """Findings for headings whose title or anchor stood earlier in the file; extra.first_line says where."""
    return _structure(repeated(headings(lines)))


def roman_value(numeral: Column) -> Column:
    """The number of a Roman numeral, read from the right: a digit below the greatest so far counts negative."""
    values = F.create_map(*(F.lit(v) for pair in ROMAN for v in pair))
    digits = F.transform(F.reverse(F.split(F.upper(numeral), "")), lambda c: F.element_at(values, c))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    state = "struct<total:int,most:int>"
    step = lambda s, d: F.struct((s["total"] + F.when(d < s["most"], -d).otherwise(d)).alias("total"), F.greatest(s["most"], d).alias("most")).cast(state)
    total = F.aggregate(digits, zero.cast(state), step)["total"]
    return F.when(total > 0, total)


def chapter_order(lines: DataFrame) -> DataFrame:
    """Findings for chapters that don't start at I or don't follow the previous one; a repeated number is fine."""
    x = headings(lines).withColumn("chapter", F.when(F.col("title").rlike(pattern(CHAPTER, True)), roman_value(F.regexp_extract("title", pattern(CHAPTER, True), 1)))).where("chapter is not null")
    x = x.withColumn("before", F.lag("chapter").over(along())).withColumn("first_line", F.lag("line_no").over(along()))
    wrong = x.where("(before is null and chapter <> 1) or (before is not null and chapter <> before and chapter <> before + 1)")
    return _structure(wrong.select(*FILE, "line_no", F.col("title").alias("quote"), F.lit("chapter_sequence").alias("issue_type"), F.coalesce("first_line", "line_no").alias("first_line")))


def numbered_lists(lines: DataFrame) -> DataFrame:
    """Findings for blocks of numbered lines: all the same number with ')', or the first line that breaks the sequence."""
    x = without_fences(lines).where(strip(F.col("line")) != "")
    item = F.col("line").rlike(NUMBERED) & ~strip(F.col("line")).rlike(HEADING)
    x = x.withColumn("item", item).withColumn("block", F.sum((~F.col("item")).cast("int")).over(along().rowsBetween(W.unboundedPreceding, 0))).where("item")
    x = x.withColumn("number", F.regexp_extract("line", NUMBERED, 2).cast("decimal(38,0)")).withColumn("marker", F.regexp_extract("line", NUMBERED, 3)).withColumn("quote", strip(F.col("line")))
    block = along(*FILE, "block")
    whole = W.partitionBy(*FILE, "block")
    x = x.withColumn("n", F.row_number().over(block)).withColumn("first", F.first("number").over(block)).withColumn("before", F.lag("number").over(block)).withColumn("first_line", F.lag("line_no").over(block))
    x = x.withColumn("size", F.count(F.lit(1)).over(whole)).withColumn("low", F.min("number").over(whole)).withColumn("high", F.max("number").over(whole)).withColumn("dots", F.min((F.col("marker") == ".").cast("int")).over(whole))
    x = x.where("size >= 2 and not (dots = 1 and low = high and low = 1)")
    same = x.where("dots = 0 and size >= 3 and low = high and n = 2").withColumn("issue_type", F.lit("repeated_numbered_list_items"))
    broken = x.where("not (dots = 0 and size >= 3 and low = high)").where(F.col("number") != F.col("first") + F.col("n") - 1)
    broken = first_in(broken, [*FILE, "block"], ["line_no"]).withColumn("issue_type", F.when(F.col("number") <= F.col("before"), "numbered_list_reset").otherwise("numbered_list_out_of_order"))
    columns = [*FILE, "line_no", "quote", "issue_type", "first_line"]
    return _structure(same.select(*columns).unionByName(broken.select(*columns)))


def _words(c: Column) -> Column:
    return F.size(F.split(c, r"(?U)\s+"))


def labels(lines: DataFrame) -> DataFrame:
    """Findings for labels (Output, Example, ...) without a colon that a value follows, on the line or within the next three."""
    x = without_fences(lines)
    regex = pattern(LABEL, True)
    x = x.withColumn("is_label", F.col("line").rlike(regex)).withColumn("rest", strip(F.regexp_extract("line", regex, 2))).withColumn("text", strip(F.col("line")))
    w = along()
    following = F.coalesce(*(F.when(F.lead("text", k).over(w) != "", F.struct(F.lead("text", k).over(w).alias("text"), F.lead("is_label", k).over(w).alias("is_label"))) for k in (1, 2, 3)))
    x = x.withColumn("next", following).where("is_label").where(~F.col("rest").rlike("^[:：]"))

    def value(c: Column, starts: tuple[str, ...], words: int, size: int) -> Column:
        opens = F.substring(c, 1, 1).isin(*starts) | c.rlike(r"(?U)^\d")
        return ~c.rlike(pattern(PROSE, True)) & (opens | ((_words(c) <= words) & (F.char_length(c) <= size)))

    inline = ~F.col("rest").rlike(pattern(PROSE, True)) & (value(F.col("rest"), VALUE_START, 4, 80) | F.col("rest").contains("\\n") | F.col("rest").contains("/"))
    below = F.coalesce(~F.col("next.is_label") & value(F.col("next.text"), NEXT_START, 6, 120), F.lit(False))
    x = x.where(F.when(F.col("rest") != "", inline).otherwise(below))
    return findings(
        x.select(
            "unit_id", F.col("relative_path").alias("file_path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.substring("text", 1, 320).alias("quote"),
            F.lit("readability").alias("criterion"), F.lit("minor").alias("severity"), F.lit("warning").alias("verdict"), F.lit(0.92).alias("confidence"),
            F.lit("label_punctuation_checker").alias("checker_name"), F.lit("missing_label_colon").alias("issue_type"), F.lit(False).alias("needs_human_review"),
            F.create_map(F.lit("label"), F.regexp_extract("line", regex, 1)).alias("extra"),
        )
    )

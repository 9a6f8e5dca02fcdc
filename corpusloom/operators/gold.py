"""Human labels as they come: sheets of problems, their criteria, single cases and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.files import CRITERION_LABELS
from .evaluate import sequence_ratio
from .lines import first_in

# Markers of criteria in the order of precedence, headings, patterns of lines and lists.
PROBLEM_MARKERS = (
    ("links", ("ссылка", "url", "api", "сервис")),
    ("technology_freshness", ("устар", "версии ос", "инструмент", "библиотек", "технолог", "фреймворк", "стек")),
    ("facts", ("факт", "определени", "пример", "логик", "противореч", "неверн")),
    ("readability", ("опечат", "граммат", "орфограф", "формулиров", "нумерац", "двоеточ")),
    ("checklist_alignment", ("чек-лист", "чеклист", "check-list", "несоответствие задания чек-листу", "несоответствие задания чеклисту")),
    ("correctness", ("ошибка в задании", "нарушение логики", "логик", "противореч", "некоррект", "неверн", "ошибка в доп материалах", "ошибка в дополнительных материалах")),
)
DETAIL_MARKERS = (
    ("links", ("сломанная ссылка", "битая ссылка", "неверная ссылка", "url", "http", "https")),
    ("technology_freshness", ("неактуаль", "устар", "старый стандарт", "версии ос", "библиотек", "стек")),
    ("facts", ("факт", "определение", "пример", "таблица вывода", "расхождение")),
    ("checklist_alignment", ("в чеклисте", "в чек-листе", "чеклист", "чек лист")),
    ("readability", ("опечат", "нумерация", "пронумер", "грамматика")),
    ("correctness", ("противореч", "некоррект", "по факту", "не является", "отсутствует")),
)
CASE_MARKERS = (
    ("links", ("сломанная ссылка", "ссылка", "url", "http", "https")),
    ("technology_freshness", ("устар", "неактуаль", "версии ос", "библиотек", "фреймворк", "стек")),
    ("checklist_alignment", ("чеклист", "чек-лист", "чек лист", "check-list", "checklist")),
    ("readability", ("опечат", "двоеточ", "нумерац", "пронумер", "граммат", "тавтолог", "формулиров", "кавыч", "input ", "output", "example", "result")),
    ("correctness", ("противореч", "некоррект", "неверн", "не является", "по факту", "ошибка в задании")),
)
SHEET_HEADS = ("строка - проблема - решение", "строка проблема решение", "проблема - решение", "problem - solution", "line - problem - solution")
SHEET_LABELS = ("тип проблемы", "проект", "критерий", "архив", ":small_blue_diamond: description")
SOLUTIONS = ("предложение по решению", "предлагаемое решение", "решение", "аргументы и исследования", "аргументы", "исследования", "доказательства", "подтверждение", "скрины", "скриншоты")
LINE_RANGES = (
    r"^\s*(?:строк[аеи]\s*)?(\d{1,5})\s*[–—-]\s*(\d{1,5})\s+[–—-]",
    r"^\s*(?:строк[аеи]\s*)?(\d{1,5})\s+[–—-]()",
    r"\bстрок[аеи]?\s*(\d{1,5})\s*[–—-]\s*(\d{1,5})\b",
    r"\bстрок[аеи]?\s*(\d{1,5})\b(?=\s*[:.)]|\s|$)()",
)
IGNORED_TOKENS = ("master", "id", "")
WEAK_MATCH = 0.55
CODE, TEXTS, KEEPS, FILES = "критерий_код", ("Текст кейса", "Текст ошибки", "Текст"), ("Оставить (defect/opinion)", "Оставить", "Тип (авто)", "Тип"), ("Файл (якорь)", "Файл")
OPINION_KEEPS = ("мнение", "opinion", "wish", "пожелание")


def _marked(text: Column, markers) -> list[Column]:
    out = []
    for criterion, words in markers:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out.append(F.when(hit, F.lit(criterion)))
    return out


def row_criteria(problem: Column, details: Column) -> Column:
    """The criteria of a sheet's row, in order: the one that its label names (but actuality), else those of the problem, then of the details."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for p in CRITERION_LABELS.items() for x in p)), F.lower(strip(problem)))
    found = F.array(*_marked(F.lower(problem), PROBLEM_MARKERS), *_marked(F.lower(details), DETAIL_MARKERS))
    return F.when(label.isNotNull() & (label != "actuality"), F.array(label)).otherwise(F.array_distinct(F.filter(found, lambda c: c.isNotNull())))


def line_range(text: Column) -> Column:
    """struct<line_start, line_end> that a description names; nulls if none."""
    out = F.lit(None).cast("struct<line_start:int,line_end:int>")
    for rule in reversed(LINE_RANGES):
        rule = "(?iuU)" + rule
        a, b = (F.regexp_extract(text, rule, k).try_cast("int") for k in (1, 2))
        b = F.coalesce(b, a)
        out = F.when(text.rlike(rule), F.struct(F.least(a, b).alias("line_start"), F.greatest(a, b).alias("line_end"))).otherwise(out)
    return out


def case_lines(details: Column) -> Column:
    """The lines of a description that say a defect: without headings, up to the section of solutions or proofs; the whole text if there are none."""
    text = F.coalesce(details, F.lit(""))
    lines = F.transform(F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}]"), lambda v: strip(F.regexp_replace(strip(v), '^"+|"+$', "")))
    plain = lambda v: F.regexp_replace(F.regexp_replace(F.lower(v), "^[ :]+|[ :]+$", ""), r"(?U)\s+", " ")

    def starts(v: Column, words) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | plain(v).startswith(w)
        return out

    lines = F.filter(lines, lambda v: (v != "") & ~plain(v).isin(*SHEET_HEADS) & ~starts(v, SHEET_LABELS))
    stop = F.array_position(F.transform(lines, lambda v: starts(v, SOLUTIONS)), True)
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(strip(text)))


def without_marker(line: Column) -> Column:
    """A line without its list marker."""
    bullet, ordered = r"(?s)^\s*[*•]\s*(.+)$", r"(?s)^\s*\d{1,3}[.)]\s+(.+)$"
    return F.when(line.rlike(bullet), strip(F.regexp_extract(line, bullet, 1))).when(line.rlike(ordered), strip(F.regexp_extract(line, ordered, 1))).otherwise(strip(line))


def gold_cases(rows: DataFrame) -> DataFrame:
    """rows (row_number, project_id, problem, details, ...) -> a row per case and criterion: case_id, criterion, line_start, line_end, gold_text.

    A case's own words decide its criteria; if they name none, those of its row do. Rows without any criterion have no cases.
    """
    text = F.when(F.coalesce("details", F.lit("")) != "", F.col("details")).otherwise(F.coalesce("problem", F.lit("")))
    x = rows.withColumn("_row", row_criteria(F.coalesce("problem", F.lit("")), F.coalesce("details", F.lit("")))).where("size(_row) > 0")
    x = x.withColumn("_line", F.explode(F.transform(case_lines(text), lambda v, i: F.struct((i + 1).alias("n"), v.alias("raw")))))
    x = x.withColumn("gold_text", without_marker(F.col("_line.raw"))).withColumn("_range", line_range(F.col("_line.raw")))
    own = F.array_distinct(F.filter(F.array(*_marked(F.lower("gold_text"), CASE_MARKERS)), lambda c: c.isNotNull()))
    x = x.withColumn("criterion", F.explode(F.when(F.size(own) > 0, own).otherwise(F.col("_row"))))
    case_id = F.concat_ws("_", F.lit("gold"), F.col("row_number").cast("string"), "criterion", F.col("_line.n").cast("string"))
    return x.select(case_id.alias("case_id"), *(c for c in rows.columns if c not in ("problem", "details")), "criterion", F.col("_range.line_start").alias("line_start"), F.col("_range.line_end").alias("line_end"), "gold_text")


def project_name(value: Column) -> Column:
    """The form in which project names are compared (a Cyrillic s is a c)."""
    text = F.replace(F.lower(value), F.lit("с"), F.lit("c"))
    text = F.regexp_replace(F.regexp_replace(text, r"\.id_\d+.*$", ""), r"\(\d+\)", "")
    return F.trim(F.regexp_replace(text, "[^a-zа-яё0-9]+", " "))


def matched_projects(names: DataFrame, units: DataFrame) -> DataFrame:
    """names (raw_project) and units (project_id, name) -> raw_project, project_id, matched_project, score, weak: the best unit of each distinct name.

    Equal names come from a join. Others are compared with the names that share a word or two letters in a row with them;
    a name that shares neither with any has no project.
    """
    n = names.select("raw_project").distinct().withColumn("key", project_name(F.coalesce("raw_project", F.lit(""))))
    u = units.select("project_id", F.col("name").alias("matched_project"), project_name(F.col("name")).alias("unit_key"))
    same = n.where("key <> ''").join(u, F.col("key") == F.col("unit_key")).withColumn("score", F.lit(1.0))
    same = first_in(same, ["raw_project"], ["project_id"])
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: ~t.isin(*IGNORED_TOKENS)))
    a, b = tokens(F.col("key")), tokens(F.col("unit_key"))
    inside = F.col("unit_key").contains(F.col("key")) | F.col("key").contains(F.col("unit_key"))
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    lead = F.when((F.size(a) > 0) & F.array_contains(b, F.get(a, F.lit(0))), 0.25).otherwise(0.0)

    def pieces(c: str) -> Column:
        tight = F.replace(F.col(c), F.lit(" "), F.lit(""))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(tight) - 1, F.lit(1))), lambda i: F.substring(tight, i, F.lit(2)))
        return F.explode(F.array_distinct(F.concat(pairs, tokens(F.col(c))))).alias("piece")

    rest = n.join(same.select("raw_project"), n["raw_project"].eqNullSafe(same["raw_project"]), "left_anti")
    near = rest.select("raw_project", "key", pieces("key")).join(u.select("*", pieces("unit_key")), "piece").drop("piece").distinct()
    rest = rest.select("raw_project", "key").join(near.drop("key"), "raw_project", "left")
    score = F.when((F.col("key") == "") | F.col("unit_key").isNull(), 0.0).when(inside, 0.95).otherwise(F.greatest(sequence_ratio(F.col("key"), F.col("unit_key")), overlap + lead))
    rest = first_in(rest.withColumn("score", score), ["raw_project"], [F.desc("score"), "project_id"])
    columns = ["raw_project", "project_id", "matched_project", "score"]
    return same.select(*columns).unionByName(rest.select(*columns)).withColumn("weak", F.col("score") < WEAK_MATCH)


def atomic_cases(rows: DataFrame) -> DataFrame:
    """Cases of an atomic sheet (a row per case; row_number, and the sheet's columns): case_id, row_number, raw_project, criterion, line_start, line_end, gold_text, file_hint, is_opinion."""

    def cell(*names: str) -> Column:
        have = [F.col(f"`{n}`") for n in names if n in rows.columns]
        return F.trim(F.coalesce(have[0].cast("string"), F.lit(""))) if have else F.lit("")

    line, span, one = cell("Строка"), r"^\s*(\d+)\s*[-–—]\s*(\d+)\s*$", r"^\s*(\d+)\s*$"
    a = F.when(line.rlike(span), F.regexp_extract(line, span, 1)).when(line.rlike(one), F.regexp_extract(line, one, 1)).try_cast("int")
    b = F.when(line.rlike(span), F.regexp_extract(line, span, 2)).when(line.rlike(one), F.regexp_extract(line, one, 1)).try_cast("int")
    hint, keep = F.trim(F.substring_index(cell(*FILES), ";", 1)), F.lower(cell(*KEEPS))
    x = rows.select(
        F.concat_ws("_", F.lit("gold"), F.col("row_number").cast("string"), cell(CODE)).alias("case_id"), "row_number", cell("Проект").alias("raw_project"), cell(CODE).alias("criterion"),
        F.least(a, b).alias("line_start"), F.greatest(a, b).alias("line_end"), cell(*TEXTS).alias("gold_text"), F.when(hint != "", hint).alias("file_hint"),
        (keep.startswith("opinion") | keep.isin(*OPINION_KEEPS)).alias("is_opinion"),
    )
    return x.where("criterion <> '' and gold_text <> ''")

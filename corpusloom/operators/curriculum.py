"""Whether materials and topics suit the language of a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, may_match, normalize_for_match, once, pattern, strip
from .findings import findings
from .lines import FILE, first_in

# Patterns of languages, materials and topics.
JAVA, C_LANGUAGE, CPP, CSHARP = r"\bjava\b", r"(?<![a-zа-яё])c(?![a-zа-яё+#])", r"\bc\+\+\b|cpp", r"\bc#\b|csharp"
NAMES = (("java", r"\bjava\b|_jv_|java"), ("cpp", r"\bc\+\+\b|cpp|cxx"), ("csharp", r"\bcsharp\b|c#"))
SUFFIXES = (("java", ("java",)), ("c", ("c", "h")), ("cpp", ("cpp", "cc", "cxx", "hpp")), ("csharp", ("cs",)), ("javascript", ("js", "ts")))
CPP_STYLE = r"\b(?:google\s+)?c\+\+[^.\n]{0,80}\b(?:style|guide|стайл|гайд)\b|\bcppguide\b"
ASP_NET = r"\basp\.?net\b"
MAKEFILE, JAVA_BUILD = r"\bmakefile\b|\bmake\b[^.\n]{0,80}\b(?:build|target|сборк)", r"\b(?:maven|gradle|pom\.xml|build\.gradle)\b"
C_STANDARD = r"\b(?:c99|c11)\b"
REVIEW = (
    r"\b(finite\s+state\s+machine|state\s+machine|debugger|unsigned\s+types?|#?\s*define|#?\s*include|preprocessor)\b|"
    r"(конечн\w*\s+автомат\w*|отладчик\w*|беззнаков\w*\s+тип\w*|препроцессор\w*)"
)
NO_GOTO = r"(?:отказаться\s+от\s+использования|avoid|never\s+use).{0,80}\bgoto\b"
PREPROCESSOR, EXPLAINED = r"(?m)^\s*#\s*(?:define|include)\b", r"препроцесс|preprocessor|pre-processor|директив[аы]\s+препроцесс"
EXPLAINING = r"(?:что\s+такое|what\s+is|explain|объясн).{0,80}(?:#?\s*define|#?\s*include)"
NUMBERS, TYPES, UNSIGNED = r"\b(int|char|float|double)\b", r"(тип(?:ы|ах)?\s+данных|data\s+types?|числ\w*\s+тип|number\s+types?)", r"\bunsigned\b|беззнаков\w*"
STEPS, DEBUGGER = r"\b(?:quest|task|exercise|задани[ея])\s*0?\d+", r"\bdebugger\b|\bgdb\b|отладчик\w*|пошагов\w*\s+выполн"
GAME = (
    r"\b(game|pong|console\s+graphics|symbolic\s+graphics|ascii\s+graphics)\b|символьн\w*\s+график|консольн\w*\s+игр|игр[ауы]\s+.+(?:клавиатур|управлен)"
)
STATES = r"finite\s+state\s+machine|state\s+machine|конечн\w*\s+автомат"
HEAD, CODE_HEAD = 4000, 2000


def _says(text: Column, p: str) -> Column:
    return F.coalesce(text.rlike(pattern(p, True)), F.lit(False))


def _spoken(text: Column, low: Column) -> list[Column]:
    return [F.when(may_match(low, p) & _says(text, p), F.lit(name)) for name, p in (("java", JAVA), ("c", C_LANGUAGE), ("cpp", CPP), ("csharp", CSHARP))]


def language_hints(files: DataFrame, paths: DataFrame, units: DataFrame) -> DataFrame:
    """unit_id, languages: by the unit's name, the suffixes of its files, and what the head of its README says."""
    some = lambda hits: F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("language")
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    x = units.select("unit_id", some([F.when(_says(F.col("name"), p), F.lit(n)) for n, p in NAMES]))
    x = x.unionByName(paths.select("unit_id", some([F.when(suffix.isin(*s), F.lit(n)) for n, s in SUFFIXES])))
    heads = once(once(files.where("kind = 'readme'").select("unit_id", "text"), head=F.substring("text", 1, HEAD)), low=folded(F.col("head")))
    x = x.unionByName(heads.select("unit_id", some(_spoken(F.col("head"), F.col("low")))))
    return x.groupBy("unit_id").agg(F.collect_set("language").alias("languages"))


def is_instruction(path: Column, kind: Column) -> Column:
    return kind.isin("readme", "checklist", "material", "text") | F.lower(path).rlike(r"\.(md|txt|ya?ml)$")


def line_signals(lines: DataFrame, hints: DataFrame) -> DataFrame:
    """Signals of single lines: unit_id, relative_path, line_no, issue_type, severity, criterion, quote, strong; each (line, type, quote) once."""
    text = strip(F.col("line"))
    x = once(lines.where(is_instruction(F.col("relative_path"), F.col("kind"))), low=folded(F.col("line")))
    # languages make no signal of a line alone
    x = x.where(may_match(F.col("low"), CPP_STYLE, ASP_NET, MAKEFILE, C_STANDARD, REVIEW, NO_GOTO))
    x = once(x, text=text).where("text <> ''").join(hints, "unit_id", "left")
    spoken = F.filter(F.array(*_spoken(F.col("text"), F.col("low"))), lambda h: h.isNotNull())
    x = x.withColumn("all", F.array_union(F.coalesce("languages", F.array().cast("array<string>")), spoken))
    has = lambda n: F.array_contains("all", n)
    says = lambda p: may_match(F.col("low"), p) & _says(F.col("text"), p)
    rules = (
        (says(CPP_STYLE) & has("java"), "language_material_conflict", "major", "correctness", True),
        (says(CPP_STYLE) & has("c") & ~has("cpp"), "language_material_conflict", "minor", "correctness", True),
        (says(ASP_NET) & has("java"), "inappropriate_tool", "major", "correctness", True),
        (says(MAKEFILE) & has("java") & ~says(JAVA_BUILD), "language_tooling_conflict", "minor", "correctness", True),
        (says(C_STANDARD), "outdated_approach", "minor", "technology_freshness", False),
        (says(REVIEW), "topic_review", "info", "correctness", False),
        (says(NO_GOTO), "absolute_practice_claim", "minor", "correctness", True),
    )
    hits = [F.when(c, F.struct(F.lit(i).alias("rule_no"), F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), F.lit(k).alias("criterion"), F.lit(strong).alias("strong"))) for i, (c, t, s, k, strong) in enumerate(rules)]
    x = x.select(*FILE, "line_no", F.substring("text", 1, 320).alias("quote"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select(*FILE, "line_no", "quote", "h.*")
    x = first_in(x.withColumn("_key", normalize_for_match(F.col("quote"))), [*FILE, "line_no", "issue_type", "_key"], ["rule_no"])
    return x.drop("_key", "rule_no")


def missing_topics(files: DataFrame, hints: DataFrame) -> DataFrame:
    """Signals for units in C that use or need a topic which their instructions don't explain, at their first line of text."""
    c_units = hints.where(F.array_contains("languages", "c")).select("unit_id")
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    rank = F.when(F.col("kind") == "readme", 0).when(F.col("kind") == "checklist", 1).when(F.col("kind") == "material", 2).otherwise(3)
    own = is_instruction(F.col("relative_path"), F.col("kind"))
    lines = F.transform(F.split("text", "\n"), lambda v, i: F.struct((i + 1).alias("line_no"), strip(v).alias("quote")))
    first = F.get(F.filter(lines, lambda v: (v["quote"] != "") & ~v["quote"].startswith("#")), F.lit(0))
    x = files.join(c_units, "unit_id", "left_semi").withColumns({"rank": rank, "own": own, "first": F.when(own, first), "code": F.when(suffix.isin("c", "h"), F.substring("text", 1, CODE_HEAD))})
    pieces = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("relative_path", c.alias("t"))))), lambda v: v["t"]), "\n")
    anchor = F.min(F.when(F.col("first").isNotNull(), F.struct("rank", "relative_path", "first")))
    x = x.groupBy("unit_id").agg(pieces(F.when(F.col("own"), F.col("text"))).alias("said"), pieces(F.col("code")).alias("code"), anchor.alias("anchor")).where("anchor is not null")
    said, code = F.col("said"), F.col("code")
    steps = F.size(F.regexp_extract_all(said, F.lit(pattern(STEPS, True)), F.lit(0))) >= 3
    builds = F.lower(said).contains("gcc") | F.lower(said).contains("компил")
    rules = (
        (code.rlike(PREPROCESSOR) & ~_says(said, EXPLAINED) & ~_says(said, EXPLAINING), "preprocessor", "minor"),
        (_says(said, NUMBERS) & _says(said, TYPES) & ~_says(said, UNSIGNED), "unsigned_types", "minor"),
        (builds & steps & ~_says(said, DEBUGGER), "debugger", "info"),
        (_says(F.concat_ws("\n", said, code), GAME) & ~_says(said, STATES), "state_machine", "info"),
    )
    hits = [F.when(c, F.struct(F.lit(t).alias("topic"), F.lit(s).alias("severity"))) for c, t, s in rules]
    x = x.select("unit_id", "anchor", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return x.select("unit_id", F.col("anchor.relative_path").alias("relative_path"), F.col("anchor.first.line_no").alias("line_no"), F.substring("anchor.first.quote", 1, 320).alias("quote"), F.lit("missing_key_topic").alias("issue_type"), "h.severity", F.lit("correctness").alias("criterion"), F.lit(True).alias("strong"), "h.topic")


def curriculum_findings(signals: DataFrame) -> DataFrame:
    """Strong signals as findings."""
    extra = F.create_map(F.lit("topic"), "topic") if "topic" in signals.columns else F.create_map().cast("map<string,string>")
    x = signals.where("strong").select(
        "unit_id", F.col("relative_path").alias("file_path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "quote", "criterion", "severity", "issue_type",
        F.lit("warning").alias("verdict"), F.lit(0.86).alias("confidence"), F.lit("curriculum_relevance_checker").alias("checker_name"), F.lit(True).alias("needs_human_review"), extra.alias("extra"),
    )
    return findings(x)

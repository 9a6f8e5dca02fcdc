"""Placeholders, long lines, languages, editorial rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, may_match, normalize_for_match, once, pattern, strip
from .findings import findings
from .lines import FILE, batches, first_in, is_fence, lines, top_n, without_fences

# Patterns, markers and thresholds of the rules.
PLACEHOLDER = (
    r"\b(TODO|TBD|FIXME|lorem ipsum)\b|\bздесь\s+будет\s+(?:текст|описание|картинка|изображение|пример|раздел|таблица|ссылка)\b|\b(?:дописать|заглушка)\b"
)
LONG_LINE, LONG_LINES_PER_FILE = 260, 8
PATH_LANGUAGES = (("RUS", ("_rus", "рус")), ("UZ", ("_uzb", "_uz")), ("TG", ("_tg", "taj")), ("ENG", ("_eng",)))
TAJIK = "[қғӯҳҷӣ]"
UZBEK = ("o‘", "g‘", "o'", "g'", "bo'lim", "uchun", "kerak", "loyiha", "tekshir")
EDITORIAL = (
    ("typo", r"\bCOMANY\b"),
    ("wording", r"\bкомпилируем(?:ый|ого|ым)\s+многопоточный\s+язык\b"),
    ("wording", r"\bустановка\s+для\s+редактора\s+Visual Studio Code\b"),
    ("tautology", r"\bзавершить\s+нажатие\s+нужно\s+нажатием\s+Enter\b"),
    ("case", r"\bпоступают\s+неупорядоченные\b"),
    ("case", r"\bспециализаци(?:ю|я)\s+врача\b.*\bи\s+дата\s+визита\b"),
    ("case", r"\bв\s+компании\s+работались\b"),
)
ASP_NET = r"\basp\.?net\b"
CODE_QUOTE = r"(«[A-Za-z][A-Za-z0-9 _./:-]{2,}»|\"[A-Za-z][A-Za-z0-9 _./:-]{2,}\")"


def placeholders(lines: DataFrame) -> DataFrame:
    """A finding per line with a placeholder."""
    x = lines.withColumn("text", strip(F.col("line"))).where(F.col("text").rlike(pattern(PLACEHOLDER, True)))
    return findings(
        x.select(
            "unit_id", F.col("relative_path").alias("file_path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.substring("text", 1, 320).alias("quote"),
            F.lit("readability").alias("criterion"), F.lit("major").alias("severity"), F.lit("fail").alias("verdict"), F.lit(0.9).alias("confidence"),
            F.lit("readability_checker").alias("checker_name"), F.lit("placeholder").alias("issue_type"), F.lit(True).alias("needs_human_review"),
        )
    )


def long_lines(lines: DataFrame, longer_than: int = LONG_LINE, per_file: int = LONG_LINES_PER_FILE) -> DataFrame:
    """unit_id, relative_path, line_no, n_chars: README and material lines to be judged, the first `per_file` of a file."""
    long = F.char_length("line") > longer_than  # stripping never makes a line longer, and costs more than its length
    x = lines.where(F.col("kind").isin("readme", "material") & long).withColumn("n_chars", F.char_length(strip(F.col("line")))).where(F.col("n_chars") > longer_than)
    return top_n(x, list(FILE), ["line_no"], per_file).select(*FILE, "line_no", "n_chars")


def path_language(path: Column, languages=PATH_LANGUAGES) -> Column:
    """The language that a path names; the first rule counts."""
    low, out = F.lower(path), None
    for name, marks in languages:
        hit = low.contains(marks[0])
        for m in marks[1:]:
            hit = hit | low.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def content_language(text: Column, head: int | None = 6000) -> Column:
    """TG, UZ, RUS or ENG by the letters of the first `head` code points (None: of all); null below 40 letters or without a majority of two to one."""
    sample = F.lower(text if head is None else F.substring(text, 1, head))
    count = lambda others: F.char_length(F.regexp_replace(sample, others, ""))
    letters, cyrillic, latin = count(r"\P{L}+"), count("[^а-яё]+"), count("[^a-z]+")
    uzbek = sample.rlike("|".join(UZBEK))
    return F.when(letters >= 40, F.when(sample.rlike(TAJIK), "TG").when((latin > cyrillic * 2) & uzbek, "UZ").when(cyrillic > latin * 2, "RUS").when(latin > cyrillic * 2, "ENG"))


def language_mismatches(files: DataFrame, languages=PATH_LANGUAGES) -> DataFrame:
    """Findings for files whose path and text say different languages; extra has both."""
    x = files.withColumn("expected", path_language(F.col("relative_path"), languages)).where("expected is not null")
    # behind a generator, so that the condition doesn't look at the text a second time
    x = x.withColumn("detected", F.explode(F.array(content_language(F.col("text"))))).where("detected <> expected")
    return findings(
        x.select(
            "unit_id", F.col("relative_path").alias("file_path"), F.lit("language").alias("criterion"), F.lit("minor").alias("severity"), F.lit("warning").alias("verdict"),
            F.lit(0.75).alias("confidence"), F.lit("language_coverage_checker").alias("checker_name"), F.lit("language_mismatch").alias("issue_type"), F.lit(True).alias("needs_human_review"),
            F.create_map(F.lit("expected"), "expected", F.lit("detected"), "detected").alias("extra"),
        )
    )


def language_coverage(files: DataFrame, expected: list[str], languages=PATH_LANGUAGES) -> DataFrame:
    """unit_id, languages, missing, coverage_ratio (null if none are expected)."""
    own = F.coalesce(path_language(F.col("relative_path"), languages), content_language(F.col("text")), F.when(F.col("kind") == "readme", "ENG"))
    x = files.groupBy("unit_id").agg(F.array_sort(F.collect_set(own)).alias("languages"))
    wanted = F.array(*map(F.lit, expected)) if expected else F.array().cast("array<string>")
    x = x.withColumn("missing", F.array_except(wanted, "languages"))
    ratio = (len(expected) - F.size("missing")) / len(expected) if expected else F.lit(None).cast("double")
    return x.withColumn("coverage_ratio", ratio)


def prose_lines(lines: DataFrame) -> DataFrame:
    """Lines of natural language outside code, without heading marks."""
    x = without_fences(lines).withColumn("line", F.regexp_replace(strip(F.col("line")), r"^#{1,6}\s*", "")).where("line <> ''")
    noise = F.col("line").startswith("<!--") | F.col("line").rlike(r"^[-*_=\s]{3,}$") | F.col("line").rlike(r"^https?://\S+$") | (F.col("line").startswith("|") & F.col("line").endswith("|"))
    return x.where(~noise)


# Diagrams and other artifacts whose text is looked at.
ARTIFACT_SUFFIXES, ARTIFACT_BYTES = ("drawio", "xml", "svg"), 1_000_000


def artifact_lines(contents: DataFrame, files: DataFrame) -> DataFrame:
    """contents (unit_id, relative_path, content, size_bytes) -> the lines, with their numbers, of diagrams and XML files that aren't among the text files already.

    What isn't UTF-8 in them is left out; larger files aren't looked at, and blank lines neither.
    """
    suffix = F.regexp_extract(F.lower("relative_path"), r"\.([^./]+)$", 1)
    own = contents.where(suffix.isin(*ARTIFACT_SUFFIXES) & (F.col("size_bytes") <= ARTIFACT_BYTES))
    known = files.select("unit_id", F.lower("relative_path").alias("_low")).distinct()
    own = own.withColumn("_low", F.lower("relative_path")).join(known, ["unit_id", "_low"], "left_anti")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    x = own.select("unit_id", "relative_path", F.lit("text").alias("kind"), F.regexp_replace(text, r"\r\n?", "\n").alias("text"))
    return lines(x).where(strip(F.col("line")) != "")


def java_units(files: DataFrame) -> DataFrame:
    """unit_id of units with a Java file."""
    return files.where(F.lower("relative_path").endswith(".java")).select("unit_id").distinct()


def editorial(own_lines: DataFrame, java_units: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """Findings of the editorial rules on prose lines, and on all lines of artifacts; java_units (unit_id) also get the ASP.NET rule."""
    rules = [(t, pattern(p, True), 0.88) for t, p in EDITORIAL]
    # the others can't hit, nor change where code begins and ends
    may = may_match(F.col("folded"), *(p for _, p in EDITORIAL), *([] if java_units is None else [ASP_NET])) | (F.col("line").contains("`") & (F.col("line").contains("«") | F.col("line").contains('"')))
    x = prose_lines(once(own_lines, folded=folded(F.col("line"))).where(is_fence(F.col("line")) | may).drop("folded"))
    if artifacts is not None:
        x = x.unionByName(artifacts.select(*x.columns))
    if java_units is not None:
        x = x.join(java_units.select("unit_id", F.lit(True).alias("java")).distinct(), "unit_id", "left")
    else:
        x = x.withColumn("java", F.lit(False))
    hits = [F.when(F.col("line").rlike(p), F.struct(F.lit(i).alias("rule_no"), F.lit(t).alias("issue_type"), F.regexp_extract("line", p, 0).alias("quote"), F.lit(c).alias("confidence"))) for i, (t, p, c) in enumerate(rules)]
    hits.append(F.when(F.coalesce("java", F.lit(False)) & F.col("line").rlike(pattern(ASP_NET, True)), F.struct(F.lit(len(rules)).alias("rule_no"), F.lit("wording").alias("issue_type"), F.regexp_extract("line", pattern(ASP_NET, True), 0).alias("quote"), F.lit(0.9).alias("confidence"))))
    hits.append(F.when(F.col("line").contains("`") & F.col("line").rlike(CODE_QUOTE), F.struct(F.lit(len(rules) + 1).alias("rule_no"), F.lit("quote_style").alias("issue_type"), F.regexp_extract("line", CODE_QUOTE, 0).alias("quote"), F.lit(0.82).alias("confidence"))))
    x = x.select(*FILE, "line_no", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select(*FILE, "line_no", "h.*")
    x = first_in(x.withColumn("_key", normalize_for_match(F.col("quote"))), [*FILE, "line_no", "issue_type", "_key"], ["rule_no"])
    return findings(
        x.select(
            "unit_id", F.col("relative_path").alias("file_path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "quote", "confidence", "issue_type",
            F.lit("readability").alias("criterion"), F.lit("minor").alias("severity"), F.lit("warning").alias("verdict"), F.lit("spelling_wording_checker").alias("checker_name"), F.lit(True).alias("needs_human_review"),
        )
    )


def editorial_windows(lines: DataFrame, size: int = 25, per_unit: int = 12) -> DataFrame:
    """Windows of `size` prose lines that hold connected text: 80 letters and punctuation; the first `per_unit` of a unit."""
    x = batches(prose_lines(lines), size)
    x = x.where((F.regexp_count("text", F.lit("[A-Za-zА-Яа-яЁё]")) >= 80) & F.col("text").rlike("[.:;!?—-]"))
    return top_n(x, ["unit_id"], ["relative_path", "batch"], per_unit)

"""Signals about a unit as a whole: market context, languages of its code and materials, calls documented in several files, claims to check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folded, may_match, needles, normalize_for_match, once, pattern, sentences, strip
from .findings import findings
from .lines import FILE, first_in, sticky_state

# Patterns and word lists of the rules.
MARKET = {
    "real_data": (
        r"\b(dataset|datasets|real data|production data|historical data|customer data|sales data|transaction data|kaggle|open data|huggingface datasets|uci repository|data source)\b",
        r"(датасет\w*|выборк\w*|реальн\w*\s+данн\w*|историческ\w*\s+данн\w*|открыт\w*\s+данн\w*|обезличенн\w*\s+данн\w*|данн\w*\s+(?:клиент\w*|пользовател\w*|продаж\w*|транзакц\w*|заказ\w*|заявк\w*)|набор\s+данн\w*)",
    ),
    "business_context": (
        r"\b(business problem|business case|customer problem|stakeholder|user persona|target audience|use case|client need|business process|market segment|customer base|online booking|manual labour|manual labor|employee labour costs|employee labor costs|barbershop|barbershops|booking system)\b",
        r"(бизнес[-\s]?задач\w*|бизнес[-\s]?контекст\w*|проблем\w*\s+бизнес\w*|заказчик\w*|целев\w*\s+аудитори\w*|пользовательск\w*\s+сценари\w*|потребност\w*\s+(?:клиент\w*|пользовател\w*)|бизнес[-\s]?процесс\w*|сегмент\w*\s+рынк\w*|клиентск\w*\s+баз\w*|онлайн[-\s]?запис\w*|ручн\w*\s+труд\w*|трудозатрат\w*|барбершоп\w*)",
    ),
    "success_metrics": (
        r"\b(kpi|conversion|revenue|retention|churn|nps|ltv|cac|arpu|roi|gmv|mau|dau|sla|business metric|business requirement|quality target|service level|time to resolution)\b",
        r"(бизнес[-\s]?метрик\w*|метрик\w*\s+успех\w*|kpi|конверси\w*|выручк\w*|удержан\w*|отток\w*|средн\w*\s+чек\w*|стоимост\w*\s+(?:привлечени\w*|обработк\w*)|врем\w*\s+обработк\w*|\bsla\b|бизнес[-\s]?требован\w*|требован\w*\s+бизнес\w*|целев\w*\s+показател\w*)",
    ),
}
TECHNICAL = ("autotest", "unit test", "integration test", "fixture", "mock", "expected output", "correct output", "test data", "synthetic data", "toy dataset", "тестов", "автотест", "фикстур", "мок", "ожидаем", "стандартн", "синтетическ", "игрушечн")
BUSINESS = ("business", "customer", "client", "market", "revenue", "retention", "churn", "бизнес", "клиент", "заказчик", "рынок", "выруч", "удержан", "отток")
DATA_NAME = r"(customer|client|sales|transaction|order|churn|bank|retail|market|user|billing|claim|loan|price|product|клиент|продаж|транзакц|заказ|отток|банк|рынок|пользовател|заявк|кредит|товар)"
NOISE_PATH = r"(^|/)(test|tests|fixture|fixtures|mock|mocks|expected|actual|output|outputs|report|reports|coverage|autotest|golden)(/|\.|_|-)"
CALL = r"([A-Za-z_]\w*)\s*\(([^()]*)\)\s*;?\s*//\s*(\S.*?)\s*$"
README = r"(?i)readme(?:_[a-z]+)?\.md$"
CODE = ("js", "ts", "py", "java", "go", "c", "cpp", "cc", "sql", "sh", "rb", "cs")
SOURCE_LANGUAGES = {"py": "python", "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "js": "javascript", "ts": "javascript", "rb": "ruby", "cs": "csharp"}
MATERIALS = (
    ("cpp", r"\b(?:google\s+)?c\+\+\s*(?:style|guide)\b|\bcppguide\b"), ("python", r"\bpep\s*-?\s*8\b"), ("csharp", r"\basp\.?net\b|\bc#\b"), ("go", r"\bgofmt\b|\beffective\s+go\b"),
    ("java", r"\bgoogle\s+java\s+style\b|\bcheckstyle\b"), ("javascript", r"\bairbnb\s+javascript\b|\beslint\b|\bprettier\b"), ("ruby", r"\brubocop\b"),
)
COVERED = (("cpp", "java"), ("csharp", "java"), ("cpp", "c"))
INSTRUCTION = r"(?i)(readme(?:_[a-z]+)?\.md$|materials/|instructions?)"
FACT = r"\b(deprecated|latest|lts|release|standard|style|support|supported|актуаль|устар|поддерж|стандарт|релиз|верси|используется|является|входит|доступ)\b"
FACT_DATE = r"\b(?:19|20)\d{2}(?:[-./](?:0?[1-9]|1[0-2])(?:[-./](?:0?[1-9]|[12]\d|3[01]))?)?\b"
TASK_SECTION = r"(?iuU)^\s*#{2,6}\s*(?:chapter\s+iv|chapter\s+v|description\s+of\s+tasks|task\s+\d+|exercise\s+\d+|задач[а-я]*\s+\d+|упражнен[а-я]*\s+\d+)"
THEORY_SECTION = r"(?iuU)^\s*#{2,6}\s*(?:chapter\s+iii|theory|general\s+concepts|documentation|mapping|error\s+handling|теори[яи]|основные\s+понятия|документаци[яи]|маппинг|обработка\s+ошибок)"
OPTION = r"^\s*(?:\d+[).]|[A-ZА-ЯЁ][).])\s+"
FEEDBACK = r"(feedback|опрос|educational experience|оставить отзыв|leave your feedback)"
REQUIREMENTS = (" must ", " should ", " need to ", " needs to ", " required ", " requirement ", " have to ", " we recommend ", " it is necessary to ", " recommended to ", "должен", "должна", "должны", "нужно", "необходимо", "требуется", "следует", "рекоменду", "обязательно")
NAME_HINTS = (("java", "java"), ("_go_", "go"), ("_js", "javascript"), ("python", "python"))
POINTER = r"\[(?:here|there|link|source|documentation|docs|тут|здесь|сюда|ссылка|источник|документация)\]\s*\(\s*https?://[^)]+\)"
LEADING = r"^(?:before|when|if|to|перед|когда|если|чтобы)\b[^,]*,\s*(?:clone|install|define|store|create|implement|build|run|follow|write|download|configure|use|set|скопир|установ|создай|создайте|реализу|запуст|добав|склонир|настрой)\b"
LOCAL = (
    r"\b(?:program|project|application|solution|utility|script|service)\b.{0,100}\b(?:built|compiled|implemented|located|placed|stored|run|tested|uses?|contains?)\b",
    r"\b(?:программа|проект|приложение|решение|утилита|скрипт|сервис)\b.{0,100}\b(?:собирается|компилируется|реализуется|располагается|лежит|запускается|тестируется|использует|содержит)\b",
    r"\b(?:target|makefile target|turn-in|files to turn in|src/|tests?/|artifacts?)\b",
    r"\b(?:цель\s+сборки|таргет|файлы\s+для\s+сдачи|артефакт[а-я]*)\b",
)
DEFINITION = r"^\s*(?:\*\*)?[A-ZА-ЯЁ][^:\n]{1,90}(?:\*\*)?\s*[:—-]\s+\S"
FACT_README = r"(?i)(?:^|/)readme(?:_rus)?\.md$"
SECOND_PERSON = r"\byou (?:must|need|have to|should|can)\b|\byour (?:code|project|repository|program|solution)\b"


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def market_fit(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """A finding for each unit with one to three of: real data, business context, success metrics; extra has the score and which."""
    low = F.lower(strip(F.col("line")))
    x = once(lines.where(F.col("kind").isin("readme", "material", "text")), low=low)
    # lines that no pattern can match only say that the unit has some, and such a unit scores by its paths alone
    x = once(x.where("low <> ''"), folded=folded(F.col("low"))).where(may_match(F.col("folded"), *(p for both in MARKET.values() for p in both)))
    x = x.where(~(_any(F.col("low"), TECHNICAL) & ~_any(F.col("low"), BUSINESS)))
    says = lambda p: may_match(F.col("folded"), p) & F.col("low").rlike(pattern(p, True))
    flags = {n: F.max(says(a) | says(b)).alias(n) for n, (a, b) in MARKET.items()}
    x = x.groupBy("unit_id").agg(*flags.values())
    path = F.lower("relative_path")
    data = path.rlike(r"\.(csv|xlsx|parquet|jsonl)$") & ~path.rlike(NOISE_PATH) & (path.rlike(r"(^|/)(data|dataset|datasets)/") | path.rlike(DATA_NAME))
    sets = paths.where(data).select("unit_id").distinct().withColumn("has_set", F.lit(True))
    x = x.join(sets, "unit_id", "full").withColumn("real_data", F.coalesce("real_data", F.lit(False)) | F.coalesce("has_set", F.lit(False)))
    x = x.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("business_context", "success_metrics")})
    x = x.withColumn("score", sum(F.col(n).cast("int") for n in MARKET)).where("score > 0")
    three = F.col("score") >= 3
    extra = F.create_map(F.lit("market_fit_score"), F.col("score").cast("string"), *(c for n in MARKET for c in (F.lit(n), F.col(n).cast("string"))))
    return findings(x.select("unit_id", F.lit("market_fit").alias("criterion"), F.when(three, "info").otherwise("minor").alias("severity"), F.when(three, "pass").otherwise("warning").alias("verdict"), (F.lit(0.65) + F.lit(0.1) * F.col("score")).alias("confidence"), F.lit("market_fit_checker").alias("checker_name"), F.lit("market_fit").alias("issue_type"), (~three).alias("needs_human_review"), extra.alias("extra")))


def _parsed_output(raw: Column) -> Column:
    """An expected output in comparable form: the pairs of a map whatever their order, else the text without case, spaces and quotes."""
    s = strip(F.regexp_replace(strip(raw), "^`+|`+$", ""))
    pairs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"\d+\s*:\s*-?\d+"), F.lit(0)), lambda p: F.regexp_replace(p, r"\s+", ""))))
    plain = F.regexp_replace(F.regexp_replace(F.lower(s), "^['\"`{}() ]+|['\"`{}() ]+$", ""), r"\s+", "")
    return F.when(s.contains("{") & (F.size(pairs) > 0), F.concat(F.lit("map:"), F.array_join(pairs, ","))).otherwise(F.concat(F.lit("str:"), plain))


def call_outputs(lines: DataFrame) -> DataFrame:
    """A finding for each call whose documented output differs between files; at the README if it is one of them."""
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    readme = F.col("relative_path").rlike(README)
    x = lines.where(readme | suffix.isin(*CODE)).where(F.col("line").rlike(CALL))
    raw = F.regexp_extract("line", CALL, 3)
    x = x.withColumn("raw", strip(raw)).where((F.char_length("raw") > 0) & (F.char_length("raw") <= 200))
    x = x.withColumn("call", F.concat(F.regexp_extract("line", CALL, 1), F.lit("("), F.regexp_replace(F.regexp_extract("line", CALL, 2), r"\s+", ""), F.lit(")"))).withColumn("parsed", _parsed_output(F.col("raw"))).withColumn("rank", F.when(readme, 0).otherwise(1))
    x = first_in(x, ["unit_id", "call", "relative_path"], ["line_no"])
    x = x.groupBy("unit_id", "call").agg(F.count_distinct("parsed").alias("outputs"), F.min(F.struct("rank", "relative_path", "line_no", "raw")).alias("a")).where("outputs > 1")
    return findings(
        x.select(
            "unit_id", F.col("a.relative_path").alias("file_path"), F.col("a.line_no").alias("line_start"), F.col("a.line_no").alias("line_end"), F.substring("a.raw", 1, 160).alias("quote"),
            F.lit("correctness").alias("criterion"), F.lit("major").alias("severity"), F.lit("fail").alias("verdict"), F.lit(0.85).alias("confidence"),
            F.lit("cross_file_consistency_checker").alias("checker_name"), F.lit("spec_code_output_mismatch").alias("issue_type"), F.lit(True).alias("needs_human_review"), F.create_map(F.lit("call"), "call").alias("extra"),
        )
    )


def unit_language(paths: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """unit_id, language: of most source files, without tests and build scripts; ties by name. Units (unit_id, name) without any have that of their name, if it names one."""
    path = F.lower("relative_path")
    base = F.substring_index(path, "/", -1)
    table = F.create_map(*(F.lit(x) for pair in SOURCE_LANGUAGES.items() for x in pair))
    x = paths.where(~path.contains("test") & ~base.isin("build.py", "conftest.py", "setup.py", "add_args.py"))
    x = x.withColumn("language", F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1))).where("language is not null")
    x = x.groupBy("unit_id", "language").agg(F.count(F.lit(1)).alias("n"))
    x = first_in(x, ["unit_id"], [F.desc("n"), "language"]).select("unit_id", "language")
    if units is None:
        return x
    named = F.coalesce(*(F.when(F.lower("name").contains(hint), language) for hint, language in NAME_HINTS))
    return x.unionByName(units.select("unit_id", named.alias("language")).where("language is not null").join(x, "unit_id", "left_anti"))


def foreign_materials(lines: DataFrame, paths: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Findings for style guides and frameworks of another language than the unit's code; the first of a file and language."""
    hits = [F.when(F.col("line").rlike(pattern(p, True)), F.lit(lang)) for lang, p in MATERIALS]
    x = lines.where(F.col("relative_path").rlike(INSTRUCTION)).select(*FILE, "line_no", "line", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("tech"))
    x = x.join(unit_language(paths, units), "unit_id").where("tech <> language")
    for tech, own in COVERED:
        x = x.where(~((F.col("tech") == tech) & (F.col("language") == own)))
    x = first_in(x, [*FILE, "tech"], ["line_no"])
    return findings(
        x.select(
            "unit_id", F.col("relative_path").alias("file_path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.substring(strip(F.col("line")), 1, 160).alias("quote"),
            F.lit("correctness").alias("criterion"), F.lit("major").alias("severity"), F.lit("fail").alias("verdict"), F.lit(0.8).alias("confidence"),
            F.lit("course_material_relevance_checker").alias("checker_name"), F.lit("course_language_material_mismatch").alias("issue_type"), F.lit(True).alias("needs_human_review"),
            F.create_map(F.lit("tech_lang"), "tech", F.lit("unit_lang"), "language").alias("extra"),
        )
    )


def clean_claim(text: Column) -> Column:
    text = F.regexp_replace(strip(text), r"^\s*(?:#{1,6}|[-*]|\d+[.)])\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(text, r"\[([^\]]+)\]\(([^)]+)\)", "$1"), r"(?U)\s+", " "))


def is_claim_noise(s: Column, claim: Column) -> Column:
    """Headings, table rows, options, navigation, pointers to sources, requirements, instructions and statements on the project itself aren't facts to check. s: the stripped text, claim: the same as clean_claim has it."""
    low = F.concat(F.lit(" "), F.lower(claim), F.lit(" "))
    words = lambda c: F.regexp_count(c, F.lit(r"(?U)\w+"))
    inner, pointer = r"\[[^\]]+\]\(\s*#[^)]+\)", pattern(POINTER, True)
    navigation = s.rlike(inner) & (words(F.regexp_replace(s, inner, "")) <= 3)
    pointing = s.rlike(pointer) & (words(F.regexp_replace(s, pointer, "")) <= 6)
    asked = low.rlike("|".join(REQUIREMENTS)) | claim.rlike(pattern(LEADING, True)) | claim.rlike(pattern(SECOND_PERSON, True))
    local = ~claim.rlike(FACT_DATE) & claim.rlike(pattern("|".join(LOCAL), True))
    return (s == "") | s.startswith("#") | s.rlike(r"^\s*\|.+\|\s*$") | s.rlike(pattern(FEEDBACK, True)) | s.rlike(OPTION) | navigation | pointing | asked | local


def looks_like_fact(claim: Column, technologies: str) -> Column:
    size = F.char_length(claim)
    words = F.regexp_count(claim, F.lit(r"(?U)\w+"))
    sign = claim.rlike(FACT_DATE) | claim.rlike(pattern(FACT, True)) | claim.rlike(technologies)
    return size.between(35, 520) & ~F.lower(claim).rlike(r"^(https?://|!\[|\[)") & (words >= 5) & sign


def fact_claims(lines: DataFrame, per_unit: int = 8, technologies: str = pattern(r"\b(python|java|docker|postgresql|linux|javascript|typescript|go|rust)\b", True)) -> DataFrame:
    """unit_id, claim, relative_path, line_no: sentences with a date, a version, a technology or a marker of fact, each once, the first per_unit of a unit."""
    x = sticky_state(lines.where(F.col("kind").isin("readme", "material", "text")), TASK_SECTION, THEORY_SECTION).where("not (in_task and kind = 'readme')")
    x = x.select(*FILE, "kind", "line_no", F.posexplode(sentences(F.col("line"))).alias("n", "sentence"))
    x = x.select("*", F.inline(F.array(F.struct(strip(F.col("sentence")).alias("s"), clean_claim(F.col("sentence")).alias("claim"))))).drop("sentence").withColumnRenamed("s", "sentence")
    x = x.where(~is_claim_noise(F.col("sentence"), F.col("claim"))).where(looks_like_fact(F.col("claim"), technologies))
    rank = F.when(F.col("kind") == "readme", 0).when(F.col("kind") == "material", 1).otherwise(2)
    order = ["rank", "relative_path", "line_no", "n"]
    x = first_in(x.withColumn("rank", rank).withColumn("key", normalize_for_match(F.col("claim"))), ["unit_id", "key"], order)
    w = W.partitionBy("unit_id").orderBy(*order)
    return x.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_unit).select("unit_id", "k", "claim", "relative_path", "line_no")


TECHNOLOGIES = pattern(r"\b(python|java|docker|postgresql|linux|javascript|typescript|go|rust)\b", True)


def fact_lines(lines: DataFrame, technologies: str = TECHNOLOGIES) -> DataFrame:
    """The lines of README.md and README_RUS.md, outside tasks, that state a fact to check or define a term."""
    rows = once(lines.where(F.col("relative_path").rlike(FACT_README)), _low=folded(F.col("line")))
    # a claim has no letters but those of its line, and stands in it as it is but for links and white space; other lines can't count, nor change the section
    signs = (FACT_DATE, FACT, technologies)
    whole = any(w != "".join(w.split()) for p in signs for w in needles(p) or ())
    may = F.lit(True) if whole else may_match(F.col("_low"), *signs) | F.col("line").contains(":") | F.col("line").contains("](")
    rows = rows.where(F.col("line").contains("##") | ((F.char_length("line") >= 20) & may)).drop("_low")
    x = sticky_state(rows, TASK_SECTION, THEORY_SECTION).where(~F.col("in_task")).drop("in_task")
    # as rows of a generator, so that filters can't take the expressions apart and work them out again for each pattern
    x = x.select("*", F.inline(F.array(F.struct(strip(F.col("line")).alias("_s"), clean_claim(F.col("line")).alias("_claim")))))
    claim = F.col("_claim")
    defined = F.char_length(claim).between(20, 520) & claim.rlike(DEFINITION) & (claim.rlike(pattern(FACT, True)) | claim.rlike(technologies) | claim.contains(":"))
    return x.where(~is_claim_noise(F.col("_s"), claim)).where(looks_like_fact(claim, technologies) | defined).drop("_s", "_claim")


def fact_batches(lines: DataFrame, size: int = 90, most: int = 8, technologies: str = TECHNOLOGIES) -> DataFrame:
    """unit_id, batch, relative_path, line_start, line_end, text, allowed_lines: fact lines with their numbers, `size` a batch, the first `most` batches of a unit by file and line.

    Batches don't run over the ends of files. The first lines of each unit are found before anything is collected, so a
    task holds no more than most * size lines of a unit at once.
    """
    by_file = W.partitionBy(*FILE).orderBy("line_no")
    x = fact_lines(lines, technologies).withColumn("part", F.floor((F.row_number().over(by_file) - 1) / size).cast("int"))
    # of a file no more than `most` batches can count, and of a unit no more than its first `most` batches
    x = x.where(F.col("part") < most).withColumn("low", F.lower("relative_path"))
    starts = x.groupBy("unit_id", "low", "relative_path", "part").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("unit_id").orderBy("low", "relative_path", "part")
    starts = starts.withColumn("batch", F.row_number().over(order) - 1).where(F.col("batch") < most).drop("low", "n")
    body = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    x = x.join(starts, ["unit_id", "relative_path", "part"]).groupBy("unit_id", "batch", "relative_path").agg(body.alias("body"))
    text = F.array_join(F.transform("body", lambda r: F.concat(r["line_no"].cast("string"), F.lit(": "), r["line"])), "\n")
    numbers = F.transform("body", lambda r: r["line_no"])
    return x.select("unit_id", "batch", "relative_path", F.array_min(numbers).alias("line_start"), F.array_max(numbers).alias("line_end"), text.alias("text"), numbers.alias("allowed_lines"))

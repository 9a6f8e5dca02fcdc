"""Check-lists against the README, the files and the artifacts of their unit."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folded, may_match, normalize_for_match, once, pattern
from ..materialize import written
from .evaluate import sequence_ratio
from .findings import findings
from .lines import first_in

# Words and patterns of the rules.
STOP_TOKENS = ("part", "task", "step", "section", "chapter", "module", "exercise", "project", "qism", "часть", "раздел", "задание")
UNNAMED_KEYS = ("name", "id", "uuid")
ACCEPTANCE = (
    r"\b(must|should|check(?:s|ed|ing)?|criteria|criterion|expected|verify|validate|valid|invalid|error|incorrect|accepted|rejected)\b|"
    r"(долж|следует|провер|критери|ожида|ошиб|валид|некоррект|принима)"
)
ARTIFACT = (
    r"`[^`]+`|\b[\w./-]+\.(?:c|h|cpp|cc|py|js|ts|java|go|rs|rb|sh|sql|md|yml|yaml|json|txt|csv|png|jpg|jpeg|svg)\b|"
    r"\b(makefile|make|target|file|folder|directory|artifact|input|output|src|tests?)\b|(файл|папк|каталог|артефакт|команд|цель|ввод|вывод|исходник|тест)"
)
EXAMPLE = r"```|\b(example|sample|template|stdin|stdout|input|output|expected output)\b|(пример|шаблон|образец|входн|выходн)"
EXERCISE = r"(?:exercise|task|quest|chapter|задани[ея]|упражнени[ея])\s*0*"
SELF_JOIN = r"\b[a-z]\w*\.id\s*[><]\s*[a-z]\w*\.id\b"
QUOTED = r'"([^"\n]{2,120})"'
RESOURCES = "dox docx pcapng pcap json csv tsv xlsx xls zip tar gz png jpg jpeg svg pdf txt".split()
GIVEN_RESOURCES = "dox docx pcapng pcap xlsx xls zip tar gz png jpg jpeg svg pdf".split()
FILE_REF = rf"`([^`\n]+\.(?:{'|'.join(RESOURCES)}))`|(?<![\w./\\-])([A-Za-zА-Яа-яЁё0-9_./\\<>-]+\.(?:{'|'.join(RESOURCES)}))\b"
LOOSE_DOCUMENT = r"(?<!\w)((?:ex|task|quest|day)\d{1,3}[A-Za-zА-Яа-яЁё0-9_./\\ <>\-]*\.(?:docx|dox))\b"
NEEDED = r"\b(provided|attached|contains|archive|dataset|capture|resource|input)\b|(прилож|архив|датасет|ресурс|дамп|входн)"
COMMANDS = ("whoami", "id", "uname", "ls", "hostname", "ifconfig", "ipconfig", "tcpdump", "tshark")
SHORT_COMMANDS = ("id", "ls", "uname")
SQL_CONDITION = r"\b(?:[a-z_]\w*\.)?[a-z_]\w*\s*(?:=|<>|!=|>=|<=|>|<)\s*(?:'[^'\n]{1,80}'|\"[^\"\n]{1,80}\"|\d+(?:\.\d+)?|(?:[a-z_]\w*\.)?[a-z_]\w*)"
SQL_WORDS = r"\b(select|where|join|from|order\s+by|group\s+by|having|insert|update|delete)\b"
SAME_FIELD = r"\b(?:[a-z_]\w*\.)?([a-z_]\w*)\s*=\s*(?:[a-z_]\w*\.)?([a-z_]\w*)\b"
PIZZERIAS = ("pizza hut", "dominos", "domino's", "papa johns", "papa john's")
CONTENT = (
    r"\b(expected|contains?|included|attached|provided|dump|capture|pcap|trace|output|commands?)\b|"
    r"(\bожида\w*\b|\bсодерж\w*\b|\bприлож\w*\b|\bвложен\w*\b|\bдамп\w*\b|\bзахват\w*\b|\bвывод\w*\b|\bкоманд\w*\b)"
)
CONTENT_EXTENSIONS = ("pcapng", "pcap", "dump", "log", "txt", "csv", "tsv", "json", "xml", "sql")
OUTPUT_HINTS = ("command output", "result of", "output from", "reverse shell", "shell", "вывод команд", "результат команд")
OUTPUT_NOISE = ("get", "post", "http", "host", "random", "payload", "example", "test", "tcp", "udp", "result", "of")
PREFIXES = (("use case", "uc"), ("usecase", "uc"), ("use_case", "uc"), ("produse caset prefix", ""), ("product prefix", ""), ("productprefix", ""), ("prefix", ""), ("префикс продукта", ""), ("префикспродукта", ""), ("префикс", ""))
SIMILAR = 0.82

QUESTIONS = "unit_id string, relative_path string, q_index int, name string, description string, problem string"


def _loaded(text: str):
    try:
        import yaml
    except ModuleNotFoundError:  # JSON is YAML too
        return json.loads(text) if text.strip() else {}
    return yaml.safe_load(text) or {}


def _said(value, out: list[str]) -> list[str]:
    """The strings in a nested value, but for those under names and ids."""
    if isinstance(value, dict):
        for key, item in value.items():
            if str(key).lower() not in UNNAMED_KEYS:
                _said(item, out)
    elif isinstance(value, list):
        for item in value:
            _said(item, out)
    elif isinstance(value, str) and value.strip():
        out.append(value.strip())
    return out


def _asked(text: str) -> list[tuple[str, str]]:
    sections = loaded.get("sections") or [] if isinstance(loaded := _loaded(text), dict) else []
    found = [q for s in sections if isinstance(s, dict) for q in s.get("questions") or [] if isinstance(q, dict) and q.get("name")]
    return [(str(q["name"]), " ".join(_said(q, [])).strip()) for q in found]


def questions(files: DataFrame) -> DataFrame:
    """A row per question of each check-list; a list without questions or that can't be read has one row with its problem."""

    def run(batches):
        for batch in batches:
            rows = []
            for unit, path, text in zip(batch["unit_id"], batch["relative_path"], batch["text"], strict=True):
                try:
                    asked = _asked(text or "")
                except Exception as e:  # what a parser may raise on someone's file depends on the parser
                    if type(e).__module__.split(".")[0] not in ("yaml", "json"):
                        raise
                    rows.append((unit, path, 0, None, None, "yaml_error"))
                    continue
                rows += [(unit, path, i, *q, None) for i, q in enumerate(asked)] or [(unit, path, 0, None, None, "no_questions")]
            yield pd.DataFrame(rows, columns=["unit_id", "relative_path", "q_index", "name", "description", "problem"])

    return files.where("kind = 'checklist'").select("unit_id", "relative_path", "text").mapInPandas(run, QUESTIONS)


def readmes(files: DataFrame) -> DataFrame:
    """unit_id, readme: the unit's README files one after the other."""
    body = F.array_sort(F.collect_list(F.struct("relative_path", "text")))
    return files.where("kind = 'readme'").groupBy("unit_id").agg(body.alias("b")).select("unit_id", F.array_join(F.transform("b", lambda b: F.coalesce(b["text"], F.lit(""))), "\n").alias("readme"))


def match_strength(name: Column, readme: Column) -> Column:
    """strong if the README says a question's name or all its words (and one of its numbers), weak for a number alone, else null."""
    shown = normalize_for_match(F.regexp_replace(F.regexp_replace(readme, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"\(#[^)]+\)", " "))
    plain, there = normalize_for_match(name), F.split(shown, " ")
    words = F.filter(F.split(plain, " "), lambda w: ~w.isin(*STOP_TOKENS) & ~w.rlike(r"^\d*$") & (F.char_length(w) >= 2))
    numbers = F.regexp_extract_all(plain, F.lit(r"\d+"), F.lit(0))
    all_words, a_number = F.size(F.array_except(words, there)) == 0, F.arrays_overlap(numbers, there)
    by_words = F.when(F.size(words) == 0, F.when(a_number, "weak")).when(F.size(numbers) > 0, F.when(all_words & a_number, "strong").when(a_number, "weak")).otherwise(F.when(all_words, "strong"))
    return F.when((plain != "") & shown.contains(plain), "strong").otherwise(by_words)


def is_complete(description: Column) -> Column:
    """Whether a description is worked out and names two of: acceptance criteria, artifacts, examples."""
    text = F.coalesce(description, F.lit(""))
    worked_out = (F.char_length(text) >= 60) | (F.regexp_count(text, F.lit(r"(?U)\w+")) >= 8)
    signals = sum(text.rlike(pattern(p, True)).cast("int") for p in (ACCEPTANCE, ARTIFACT, EXAMPLE))
    return worked_out & (signals >= 2)


def matched(asked: DataFrame, shown: DataFrame) -> DataFrame:
    """questions with strength and is_complete; those of a list with a problem are left out."""
    x = asked.where("problem is null").join(shown, "unit_id", "left")
    return x.withColumns({"strength": match_strength(F.col("name"), F.coalesce("readme", F.lit(""))), "is_complete": is_complete(F.col("description"))})


def alignment(asked: DataFrame, shown: DataFrame) -> DataFrame:
    """A finding for each check-list: how its questions are tied to the README and described; extra has the counts."""
    count = lambda c: F.count(F.when(c, 1))
    x = matched(asked, shown).groupBy("unit_id", "relative_path").agg(F.count(F.lit(1)).alias("total"), count(F.col("strength") == "strong").alias("strong"), count(F.col("strength") == "weak").alias("weak"), count(F.col("is_complete")).alias("complete"))
    loose, bare, thin = F.col("strong") / F.col("total") < 0.5, F.col("complete") == 0, F.col("complete") / F.col("total") < 0.8
    severity = F.when(bare, "major").when(loose | thin, "minor").otherwise("info")
    confidence = F.when(bare, 0.82).when(loose, 0.65).when(thin, 0.72).otherwise(0.75)
    x = x.select("unit_id", "relative_path", severity.alias("severity"), F.when(bare | loose | thin, "warning").otherwise("pass").alias("verdict"), confidence.alias("confidence"), F.lit("checklist_alignment").alias("issue_type"), F.create_map(*(v for c in ("total", "strong", "weak", "complete") for v in (F.lit(c), F.col(c).cast("string")))).alias("extra"))
    broken = asked.where("problem is not null").select("unit_id", "relative_path", F.when(F.col("problem") == "yaml_error", "critical").otherwise("major").alias("severity"), F.lit("fail").alias("verdict"), F.when(F.col("problem") == "yaml_error", 0.95).otherwise(0.9).alias("confidence"), F.col("problem").alias("issue_type"), F.create_map().cast("map<string,string>").alias("extra"))
    return _made(x.unionByName(broken))


def _made(x: DataFrame) -> DataFrame:
    return findings(x.withColumn("file_path", F.col("relative_path")).withColumns({"criterion": F.lit("checklist_alignment"), "checker_name": F.lit("checklist_checker"), "needs_human_review": F.col("verdict") != "pass"}))


def sections(shown: DataFrame) -> DataFrame:
    """unit_id, number, section: the README's exercises, the first of each number."""
    start = rf"#{{1,6}}\s*{EXERCISE}(\d+)\b"
    x = once(shown, _parts=F.split("readme", rf"(?imuU)(?=^{start})")).select("unit_id", F.posexplode("_parts").alias("at", "section"))
    x = once(x, number=F.regexp_extract("section", rf"(?iuU)^{start}", 1).try_cast("int")).where("number is not null")
    return first_in(x, ["unit_id", "number"], ["at"]).select("unit_id", "number", "section")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def _with(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def commands(text: Column) -> Column:
    """The known commands that a text names, in order of the alphabet."""

    def named(low: Column) -> Column:
        hits = []
        for c in sorted(COMMANDS):
            short = rf"`\s*{c}(?:\s|`)|\bresult\s+of\s*:\s*{c}\b|\bcommand\s+output\s+from\s+`?\s*{c}\b"
            hits.append(F.when(low.contains(c) & low.rlike(short if c in SHORT_COMMANDS else rf"(?U)(?<![\w-]){c}(?![\w-])"), F.lit(c)))
        return F.array_compact(F.array(*hits))

    return _with(F.lower(text), named)


def _clean_ref(ref: Column) -> Column:
    for mark in ("_", "-", "."):
        ref = F.replace(ref, F.lit(f"\\{mark}"), F.lit(mark))
    ref = F.regexp_replace(F.trim(ref), r"^[`'\".,;)]+|[`'\".,;)]+$", "")
    return F.trim(F.regexp_extract(ref, r"([^\\/]*)$", 1))


def file_refs(text: Column) -> Column:
    """Names of resource files in a text, in order, each once whatever its case."""
    found = F.regexp_extract_all(text, F.lit(pattern(FILE_REF, True)), F.lit(0))
    loose = F.regexp_extract_all(text, F.lit(pattern(LOOSE_DOCUMENT, True)), F.lit(1))
    bare = F.transform(found, lambda r: F.when(r.startswith("`"), F.substring(r, F.lit(2), F.char_length(r) - 2)).otherwise(r))
    refs = F.filter(F.transform(F.concat(bare, loose), _clean_ref), lambda r: r != "")
    refs = _with(F.transform(refs, lambda r: F.struct(r.alias("ref"), F.lower(r).alias("low"))), lambda rs: F.filter(rs, lambda r, i: F.array_position(rs["low"], r["low"]) == i + 1))
    return F.when(_with(folded(text), lambda low: may_match(low, FILE_REF, LOOSE_DOCUMENT)), refs["ref"]).when(text.isNotNull(), F.array().cast("array<string>"))


def _extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def _ref_key(name: Column) -> Column:
    stem = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "<[^>]+>", "")
    for a, b in PREFIXES:
        stem = F.replace(stem, F.lit(a), F.lit(b))
    return F.regexp_replace(stem, "[^a-zа-яё0-9]+", "")


def _issue(name: str, evidence: Column) -> Column:
    return F.struct(F.lit(name).alias("issue_type"), evidence.alias("evidence"))


def _section_issues(x: DataFrame) -> DataFrame:
    """x with own: issues that the README's section and a question's description show by themselves; null without a section."""
    text = F.when(F.col("section").isNotNull(), F.col("description"))
    bare = F.regexp_replace(F.when(may_match(F.col("_asked"), FILE_REF), F.regexp_replace(text, pattern(FILE_REF, True), " ")).otherwise(text), r"<[^>\n]+>", " ")
    quoted = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda v: F.trim(v))
    x = once(x, _low=F.lower("section"), _asked=folded(text))
    x = once(x, _tight=compact(F.col("section")), _quoted=quoted, _bare=bare)
    low, tight, quoted, bare = (F.col(c) for c in ("_low", "_tight", "_quoted", "_bare"))
    has = lambda *words: F.coalesce(*(F.when(low.contains(w), True) for w in words), F.lit(False))
    none = F.array().cast("array<struct<issue_type:string,evidence:string>>")
    pairs = (low.contains("person_name1") & low.contains("person_name2")) | has("pairs of", "пары", "парами")
    order = F.filter(F.regexp_extract_all(text, F.lit(pattern(SELF_JOIN, True)), F.lit(0)), lambda p: ~tight.contains(compact(p)))
    pizzas = low.contains("названия") & low.rlike(r"(?U)\bназвания\s+пицц(?:ы)?\b")
    pizzerias = has("names of pizzerias", "name of pizzerias", "названия пиццерий", "название пиццерий") & ~(has("pizza_name", "names of pizzas") | pizzas)
    counts = F.filter(F.transform(F.array_distinct(quoted), lambda v: F.struct((-F.size(F.filter(quoted, lambda q: q == v))).alias("n"), v.alias("v"))), lambda c: c["n"] <= -3)
    repeated = _with(F.array_min(counts), lambda top: F.when(top.isNotNull(), F.array(_issue("suspicious_duplicate_name_result", F.concat(top["v"], F.lit(" × "), (-top["n"]).cast("string"))))).otherwise(none))
    only_pizzas = (has("names of pizzas", "pizza names") | pizzas) & ~has("names of pizzerias", "name of pizzerias", "pizzeria", "пиццер")
    named = F.array_sort(F.array_distinct(F.filter(F.transform(quoted, F.lower), lambda v: v.isin(*PIZZERIAS))))

    def described(p: Column) -> Column:
        left, right = (F.regexp_extract(F.lower(p), pattern(SAME_FIELD), k) for k in (1, 2))
        words = low.contains(F.concat(F.lit("same "), left)) | low.contains(F.concat(F.lit("one "), left)) | (low.contains(left) & has("одинаков", "совпада"))
        return (left != "") & (left == right) & words

    open_conditions = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(pattern(SQL_CONDITION, True)), F.lit(0)), lambda p: F.trim(p)), lambda p: ~p.rlike(pattern(SELF_JOIN, True)) & ~described(p) & ~tight.contains(compact(p)))
    each = lambda name, values: F.transform(values, lambda v: _issue(name, v))
    own = F.concat(
        F.when(pairs, each("ungrounded_self_join_order", order)).otherwise(none),
        F.when(pizzerias, repeated).otherwise(none),
        F.when(may_match(F.col("_asked"), SQL_WORDS) & bare.rlike(pattern(SQL_WORDS, True)), each("ungrounded_sql_condition", F.slice(open_conditions, 1, 3))).otherwise(none),
        F.when(only_pizzas, _with(named, lambda n: F.when(F.size(n) > 0, F.array(_issue("expected_output_semantic_mismatch", F.array_join(n, ", ")))).otherwise(none))).otherwise(none),
    )
    return once(x, own=F.when(F.col("section").isNotNull(), own)).drop("_low", "_asked", "_tight", "_quoted", "_bare")


def _resource_issues(asked: DataFrame, shown: DataFrame, paths: DataFrame) -> DataFrame:
    """Files that a question names and neither the README nor the unit has: a similar name of the same kind, or a missing resource."""
    x = once(asked, _refs=file_refs(F.concat_ws(" ", "name", "description"))).withColumn("expected", F.explode("_refs")).drop("_refs")
    known = once(shown, _refs=file_refs(F.col("readme"))).select("unit_id", F.lit(0).alias("origin"), F.posexplode("_refs").alias("at", "known"))
    known = known.unionByName(paths.select("unit_id", F.lit(1).alias("origin"), F.lit(0).alias("at"), _clean_ref(F.col("relative_path")).alias("known")))
    known = known.withColumn("low", F.lower("known")).withColumn("ext", _extension(F.col("known"))).withColumn("key", _ref_key(F.col("known")))
    x = x.withColumn("low", F.lower("expected")).withColumn("ext", _extension(F.col("expected"))).withColumn("own_key", _ref_key(F.col("expected")))
    x = x.join(known.select("unit_id", "low").distinct(), ["unit_id", "low"], "left_anti")
    # only names of one unit and kind meet
    near = x.select("unit_id", "low", "ext", "own_key").distinct().join(known.drop("low"), ["unit_id", "ext"])
    near = near.withColumn("score", F.when(F.col("key") == F.col("own_key"), 2.0).otherwise(sequence_ratio(F.col("own_key"), F.col("key")))).where(F.col("score") >= SIMILAR)
    sure = F.col("score") == 2
    near = first_in(near, ["unit_id", "low"], [F.desc("score"), F.when(sure, F.col("origin")), F.when(sure, F.col("at")), "known"]).select("unit_id", "low", F.col("known").alias("similar"))
    x = x.join(near, ["unit_id", "low"], "left")
    given = F.col("ext").isin(*GIVEN_RESOURCES) | (F.col("ext").isin("json", "csv", "tsv", "txt") & F.lower("description").rlike(pattern(NEEDED)))
    issue = F.when(F.col("similar").isNotNull(), _issue("expected_file_name_mismatch", F.concat("expected", F.lit(" vs "), "similar"))).when(given, _issue("ungrounded_resource", F.col("expected")))
    return x.select("unit_id", "relative_path", "q_index", "name", issue.alias("i")).where("i is not null").select("unit_id", "relative_path", "q_index", "name", "i.*")


def _shows_output(text: Column, command: str) -> Column:
    """Whether words that look like output follow a command in a text in lower case before the next command."""
    ends = rf"(?<![\w-])(?:{'|'.join(COMMANDS)})(?![\w-])"
    tails = F.regexp_extract_all(text, F.lit(rf"(?sU)(?<![\w-]){command}(?![\w-])(?=(.{{0,160}}))"), F.lit(1))

    def says(tail: Column) -> Column:
        part = F.regexp_replace(F.regexp_extract(tail, rf"(?sU)^(.*?)(?:{ends}|$)", 1), r"\b(result of|command output|output from)\b\s*:?", " ")
        words = F.regexp_extract_all(part, F.lit("[a-zа-яё0-9_./-]+"), F.lit(0))
        return F.exists(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(*OUTPUT_NOISE))

    return text.contains(command) & F.exists(tails, says)


def _artifact_kinds(description: Column, context: Column) -> Column:
    """Extensions of the artifacts that a question speaks of without a name; null if it speaks of none."""
    capture, log, dump = r"(?U)\b(pcap|pcapng|capture)\b|(\bзахват\w*\b)", r"(?U)\b(log|trace)\b", r"(?U)\b(dump)\b|(\bдамп\w*\b)"

    def kinds(low: Column) -> Column:
        says = lambda p: may_match(low, p) & low.rlike(p)
        return F.when(says(capture), F.array(F.lit("pcap"), F.lit("pcapng"))).when(says(log), F.array(F.lit("log"), F.lit("txt"))).when(says(dump), F.array(*map(F.lit, CONTENT_EXTENSIONS)))

    return _with(F.lower(F.concat_ws("\n", description, context)), kinds)


def _artifact_issues(asked: DataFrame, paths: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Markers that a question expects inside an artifact whose text doesn't hold them.

    asked: questions with their number, the commands that they name, content (whether they speak of content) and kinds; artifacts: unit_id, ref, text (lower case).
    """
    x = asked.where("content")
    quoted = F.filter(F.transform(F.regexp_extract_all("description", F.lit(QUOTED), F.lit(1)), lambda v: F.trim(v)), lambda v: F.char_length(v).between(2, 80))
    x = once(x, _first=F.filter(F.array(*map(F.lit, COMMANDS)), lambda c: F.array_contains("named", c)), _quoted=quoted)
    x = once(x, markers=F.concat("_first", F.array_distinct(F.filter("_quoted", lambda v: ~F.array_contains("_first", F.lower(v)))))).where("size(markers) > 0")
    hinted = lambda low: reduce(Column.__or__, (low.contains(h) for h in OUTPUT_HINTS), low.contains("след") & low.contains("команд"))
    x = once(x, explicit=F.filter(file_refs(F.col("description")), lambda r: _extension(r).isin(*CONTENT_EXTENSIONS)), expects=_with(F.lower("description"), hinted))
    keys = ["unit_id", "relative_path", "q_index", "name", "number", "description", "markers", "expects"]
    said = x.where("size(explicit) > 0").select(*keys, F.posexplode("explicit").alias("at", "ref"))
    own = paths.select("unit_id", F.col("relative_path").alias("ref"), _extension(F.col("relative_path")).alias("ext"))
    meant = x.where("size(explicit) = 0 and kinds is not null").select(*keys, F.explode("kinds").alias("ext")).join(own, ["unit_id", "ext"]).select(*keys, F.lit(0).alias("at"), "ref")
    x = said.unionByName(meant)
    number = F.col("number").cast("string")
    rule = F.concat(F.lit(r"(?i)(?:task|quest|exercise|ex)[_-]?0?"), number, F.lit(r"(?!\d)|[/\\]0?"), number, F.lit(r"[/\\]"))
    whole = W.partitionBy("unit_id", "relative_path", "q_index")
    x = x.withColumn("mine", F.coalesce(F.rlike(F.col("ref"), rule), F.lit(False))).withColumn("any", F.max("mine").over(whole)).where("mine or not any")
    x = x.join(artifacts.select("unit_id", F.col("ref").alias("low"), "text"), (artifacts["unit_id"] == x["unit_id"]) & (F.col("low") == F.lower("ref"))).drop(artifacts["unit_id"])
    is_command = lambda m: F.col("expects") & F.lower(m).isin(*COMMANDS)
    shown = _with(F.lower("text"), lambda low: F.array_compact(F.array(*(F.when(_shows_output(low, c), F.lit(c)) for c in COMMANDS))))
    x = once(x, _shown=F.when(F.exists("markers", is_command), shown))
    # texts end here: a question's group holds only which of its markers they have
    held = F.filter("markers", lambda m: F.when(is_command(m), F.array_contains("_shown", F.lower(m))).otherwise(F.coalesce(F.col("text").contains(F.lower(m)), F.lit(True))))
    x = x.select(*keys, "at", "ref", held.alias("held")).groupBy(*keys).agg(F.flatten(F.collect_set("held")).alias("held"), F.array_sort(F.collect_set(F.struct("at", "ref"))).alias("refs"))
    missing = F.filter("markers", lambda m: ~F.array_contains("held", m))
    x = once(x, missing=F.array_distinct(F.transform(missing, lambda m: F.when(is_command(m), F.concat(F.lit("вывод "), m)).otherwise(m)))).where("size(missing) > 0")
    refs = F.array_distinct(F.col("refs")["ref"])
    evidence = F.concat(F.array_join(F.slice("missing", 1, 5), ", "), F.lit(" не найден в "), F.array_join(F.slice(refs, 1, 3), ", "))
    return x.select("unit_id", "relative_path", "q_index", "name", F.lit("artifact_missing_expected_text").alias("issue_type"), evidence.alias("evidence"))


def grounding(asked: DataFrame, shown: DataFrame, paths: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """unit_id, relative_path, q_index, name, issue_type, evidence: what questions demand that the README, the files and the artifacts don't bear out.

    Each (name, issue type, evidence) of a check-list once, at its first question.
    """
    number = F.regexp_extract("name", rf"(?iuU){EXERCISE}(\d+)", 1).try_cast("int")
    x = once(asked.where("problem is null").withColumn("description", F.coalesce("description", F.lit(""))), number=number)
    x = x.join(sections(shown), ["unit_id", "number"], "left").join(shown, "unit_id", "left").withColumn("context", F.coalesce("section", "readme", F.lit("")))
    keys = ["unit_id", "relative_path", "q_index", "name"]
    x = once(_section_issues(x), named=commands(F.col("description")))
    x = x.withColumn("lacking", F.when(F.size("named") > 0, F.array_except("named", commands(F.col("context")))))
    if artifacts is not None:
        x = once(x, content=_with(folded(F.col("description")), lambda low: may_match(low, CONTENT)) & F.col("description").rlike(pattern(CONTENT, True)))
        x = x.withColumn("kinds", F.when(F.col("content"), _artifact_kinds(F.col("description"), F.col("context"))))
    # the texts of READMEs are read in one pass; what follows needs only what was found in them
    x = written(x.drop("section", "readme", "context"))
    parts = [x.select(*keys, F.explode("own").alias("i")).select(*keys, "i.*"), _resource_issues(x.select(*keys, "description"), shown, paths)]
    missing = x.select(*keys, F.explode("lacking").alias("evidence")).withColumn("issue_type", F.lit("ungrounded_command"))
    if artifacts is not None:
        inside = written(_artifact_issues(x, paths, artifacts))
        said = inside.select("unit_id", "relative_path", "q_index", F.lower("evidence").alias("said"))
        missing = missing.join(said, ["unit_id", "relative_path", "q_index"], "left").where("said is null or not contains(said, evidence)").drop("said")
        parts.append(inside)
    out = parts[0]
    for p in [*parts[1:], missing]:
        out = out.unionByName(p.select(*out.columns))
    return first_in(out, ["unit_id", "relative_path", "name", "issue_type", "evidence"], ["q_index"])


def grounding_findings(issues: DataFrame) -> DataFrame:
    """The issues as findings."""
    x = issues.select("unit_id", "relative_path", "issue_type", F.col("evidence").alias("quote"), F.create_map(F.lit("question"), "name").alias("extra"))
    return _made(x.withColumns({"severity": F.lit("major"), "verdict": F.lit("warning"), "confidence": F.when(F.col("issue_type") == "artifact_missing_expected_text", 0.88).otherwise(0.84)}))

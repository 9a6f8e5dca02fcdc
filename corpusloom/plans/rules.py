"""Registered queries of single rules, over lines, paths and records that Spark makes of the given tables.

The expressions that make them are read alike by both engines; `rule_oracles` builds the same rows from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detector import Corpus, audit
from ..functions.text import normalize_for_match, split_lines, strip
from ..materialize import scratch, written
from ..operators import adjudicate, align, checklists, consistency, context, dependencies, entities, evaluate, findings, gold, matching, readability, rights, sinks, verdicts
from ..operators.images import image_quality
from ..operators.lines import lines, sticky_state, without_fences
from ..sources import files as f
from ..sources import findings_json
from ..sources import tables as t
from .queries import _matches, _subtypes, page_notes

PAGE_FILE = {"unit_id": "cast(page_id % 10 as string)", "relative_path": "'README.md'", "kind": "'readme'", "line_no": "cast(page_id as int)"}
EVENT_FILE = {"unit_id": "cast(user_id as string)", "relative_path": "'README.md'", "kind": "'readme'", "line_no": "cast(event_id as int)"}
N = "cast(page_id % 30 as string)"

#: Rows made of a table: name -> (table, columns).
MADE = {
    "image_notes": ("pages", {"unit_id": "cast(page_id % 20 as string)", "relative_path": "concat('pages/', cast(page_id as string), '.md')", "kind": "'text'", "text": "concat('See ![shot](img/', cast(page_id as string), '.png) of ', url, chr(10), 'Again ![shot](img/', cast(page_id as string), '.png)')"}),
    "fenced": ("events", {**EVENT_FILE, "line": "case when event_id % 7 = 0 then '```' else props end"}),
    "tasks": ("events", {**EVENT_FILE, "line": "case event_id % 11 when 0 then '## Task 1' when 5 then '## Theory' else props end"}),
    "pictures": ("pages", {"unit_id": "cast(page_id % 10 as string)", "file_path": "'README.md'", "line_start": "cast(page_id as int)", "value": "concat(case when page_id % 9 = 0 then 'logo' else 'img' end, '/', cast(page_id as string), '.png')", "quote": "'a picture'"}),
    "picture_sizes": ("pages", {"unit_id": "cast(page_id % 10 as string)", "relative_path": "concat(case when page_id % 9 = 0 then 'logo' else 'img' end, '/', cast(page_id as string), '.png')", "width": "cast(case when page_id % 4 = 3 then null else page_id * 37 % 1000 + 1 end as int)", "height": "cast(case when page_id % 4 = 3 then null else page_id * 53 % 600 + 1 end as int)"}),
    "definitions": ("pages", {**PAGE_FILE, "line": "case page_id % 5 when 0 then 'A Word is any symbol' when 1 then 'the word is character' when 2 then 'words are symbols' else url end"}),
    "table_lines": ("events", {**EVENT_FILE, "line": "case event_id % 9 when 0 then 'The following fields: id, name, price' when 1 then '| id | name |' when 2 then '| id | name | Price |' when 3 then '| --- | --- |' else props end"}),
    "declared": ("part", {"unit_id": "cast(p_partkey % 20 as string)", "file_path": "'package.json'", "ecosystem": "'npm'", "name": "concat('lib', cast(p_partkey % 50 as string))"}),
    "licenses": ("part", {"ecosystem": "'npm'", "name": "concat('lib', cast(p_partkey % 50 as string))", "license_spdx": "case p_partkey % 50 % 6 when 0 then 'GPL-3.0-only' when 1 then 'MIT' when 2 then 'CC-BY-SA-4.0' when 3 then 'LicenseRef-x' when 4 then null else 'Apache-2.0' end"}),
    "code_matches": ("events", {"unit_id": "cast(user_id as string)", "other_unit_id": "event_type", "similarity": "value / 100", "attributed": "event_id % 3 = 0"}),
    "risks": ("events", {"unit_id": "cast(user_id as string)", "risk": "case event_id % 5 when 0 then 'violation' when 1 then 'unlicensed' when 2 then 'no_source' when 3 then 'no_license_only' else 'unverifiable' end", "deterministic": "event_id % 3 <> 0", "confidence": "cast(0.5 as double)", "issue_type": "event_type"}),
    "manifests": ("pages", {"unit_id": "cast(page_id % 20 as string)", "relative_path": "concat('p', cast(page_id as string), case page_id % 4 when 0 then '/package.json' when 1 then '/requirements.txt' when 2 then '/Dockerfile' else '/pyproject.toml' end)", "kind": "'dependency_manifest'", "text": "case page_id % 4 when 0 then concat('{\"dependencies\":{\"lib', cast(page_id % 7 as string), '\":\"^1.', cast(page_id % 5 as string), '.0\"},\"engines\":{\"node\":\">=18\"}}') when 1 then concat('# all', chr(10), 'flask==2.', cast(page_id % 6 as string), chr(10), 'numpy>=1.2 ; x > \"3\"', chr(10), '-r other') when 2 then concat('FROM python:3.', cast(page_id % 8 as string), ' AS b', chr(10), 'FROM busybox') else concat('[project]', chr(10), 'requires-python = \">=3.', cast(page_id % 3 as string), '\"', chr(10), 'dependencies = [\"requests[socks]>=2\"]') end"}),
    "registry": ("pages", {"ecosystem": "case page_id % 9 when 7 then 'pypi' when 8 then 'docker' else 'npm' end", "name": "case page_id % 9 when 7 then 'Flask' when 8 then 'python' else concat('lib', cast(page_id % 9 as string)) end", "latest_version": "case page_id % 9 when 7 then '2.3' when 8 then '3.5' else '2.0.0' end", "source_url": "'https://registry.example'", "checked_at": "cast(null as timestamp)"}),
    "services": ("pages", {"unit_id": "cast(page_id % 20 as string)", "file_path": "'README.md'", "line_start": "cast(page_id as int)", "value": "case page_id % 6 when 0 then 'https://www.figma.com/x' when 1 then 'Docker Hub' when 2 then 'api.slack.com' when 3 then 'notion' when 4 then 'slack' else url end", "quote": "url"}),
    "responses": ("events", {"namespace": "event_type", "cache_key": "cast(event_id as string)", "model": "concat('m', cast(event_id % 3 as string))", "cache_hit": "event_id % 5 = 0", "response": "case event_id % 4 when 0 then '{\"verdict\":\"OK\",\"confidence\":\"high\",\"evidence\":\"e\"}' when 1 then '[{\"verdict\":\"warn\",\"confidence\":\"55%\",\"quote\":\"q\"},{\"verdict\":\"unclear\",\"confidence\":\"0\"}]' when 2 then '{\"findings\":[{\"verdict\":\"error\",\"confidence\":\"0,7\",\"line\":3}]}' else '{\"items\":[]}' end"}),
    "event_lines": ("events", {**EVENT_FILE, "line": "concat('The  type is ', event_type, ' of ', props)"}),
    "quoted": ("events", {"unit_id": "cast(user_id as string)", "relative_path": "'README.md'", "line": "cast(event_id as int)", "quote": "case event_id % 3 when 0 then concat('TYPE is ', event_type) when 1 then 'type was' else '' end", "confidence": "value / 10"}),
    "relations": ("events", {"gs": "cast(case when event_id % 9 = 0 then null else event_id % 50 end as int)", "ge": "cast(case event_id % 4 when 0 then null when 1 then 0 else event_id % 50 + 3 end as int)", "ps": "cast(case when user_id % 9 = 0 then null else user_id % 50 end as int)", "pe": "cast(case event_id % 3 when 0 then null else user_id % 50 + 1 end as int)"}),
    "artifact_texts": ("events", {"gold": "case event_id % 4 when 0 then 'Команда whoami: в дампе нет вывода' when 1 then 'tcpdump capture is missing' when 2 then 'whoami works' else props end", "found": "case user_id % 3 when 0 then 'pcap without whoami' when 1 then 'the trace of tcpdump not found' else 'dump missing' end"}),
    "opinion_cases": ("events", {"gold_idx": "event_id", "gold_text": "case event_id % 6 when 0 then 'По-моему, тут ошибка' when 1 then 'Лучше так' when 2 then null else props end"}),
    "issues": ("events", {"issue": "case event_id % 5 when 0 then concat(props, ' | ', event_type, ' | fix it | now | typo') when 1 then concat(props, '|', event_type) when 2 then 'case' when 3 then null else 'A B | Two Words' end", "location": "case event_id % 4 when 0 then 'a/b.md:10-12' when 1 then 'c:d:7' when 2 then 'none.md' else '' end"}),
    "rivals": ("events", {"scope": "cast(user_id as string)", "gold_idx": "event_id % 7", "pred_idx": "event_id % 5", "score": "cast((event_id * 7 + user_id) % 20 as double) / 20"}),
    "cache_rows": ("events", {"namespace": "event_type", "cache_key": "cast(user_id as string)", "checked_at": "ts", "body": "props", "is_fresh": "user_id % 3 = 0 and event_id % 2 = 0"}),
    "gold_sheet": ("labels", {"`ID единицы`": "cast(doc_id as string)", "`Критерий`": "case doc_id % 4 when 0 then ' Ссылки' when 1 then 'facts' when 2 then null else 'Качество изображений' end", "`Критичность`": "case doc_id % 3 when 0 then 'Критическая' when 1 then 'minor ' else 'средняя' end", "file_path": "case when doc_id % 2 = 0 then 'README.md' else ' ' end", "`Строка`": "case doc_id % 4 when 0 then '12' when 1 then '7.0' when 2 then 'x' else null end"}),
    "sheet_rows": ("labels", {"ordinal": "doc_id", "`Проект`": "case when doc_id % 5 = 0 then ' ' else concat(' p', cast(doc_id % 5 as string)) end", "`Проблема`": "case when doc_id % 3 = 0 then '' else 'bad' end", "`Детали`": "case when doc_id % 2 = 0 then null else ' more' end"}),
    "any_paths": ("pages", {"page_id": "page_id", "path": "case page_id % 9 when 0 then 'docs/README_RUS.md' when 1 then 'check-list.yml' when 2 then 'app/package.json' when 3 then 'Materials/a.md' when 4 then 'tests/x.txt' when 5 then 'node_modules/a.json' when 6 then 'build/a.txt' when 7 then 'src/main.py' else 'src/build/Dockerfile' end"}),
    "roots": ("pages", {"root": "case page_id % 4 when 0 then '' when 1 then concat('Courses/C ', cast(page_id as string)) when 2 then concat('проект_', cast(page_id as string)) else '--' end", "label": "case page_id % 4 when 0 then 'All Courses!' when 1 then concat('C ', cast(page_id as string)) when 2 then concat('проект_', cast(page_id as string)) else '--' end"}),
    "contents": ("pages", {"page_id": "page_id", "content": "case page_id % 3 when 0 then unhex('CFF0E8E2E5F20D0A') when 1 then unhex('D09FD1800D61') else unhex('61989862') end"}),
    "checklist_files": ("pages", {"unit_id": "cast(page_id as string)", "relative_path": "'check-list.yml'", "kind": "'checklist'", "text": "case page_id % 4 when 0 then '{\"sections\":[{\"questions\":[{\"name\":\"Task 1: pairs\",\"text\":\"Check that the expected output is: select a from t where p1.id > p2.id and p1.age = 5\"},{\"name\":\"Task 2\",\"id\":\"x\",\"text\":[\"short\", 5]}]}]}' when 1 then '{\"sections\": []}' when 2 then replace('{\"sections\":[{\"questions\":[{\"name\":\"Task 7 login form\",\"text\":\"~Pizza A~ ~Pizza A~ ~Pizza A~ must be the expected output of whoami, see the example capture dump1.pcap\"}]}]}', '~', concat(chr(92), chr(34))) else 'a: [b' end"}),
    "checklist_readmes": ("pages", {"unit_id": "cast(page_id as string)", "relative_path": "'README.md'", "kind": "'readme'", "text": "case page_id % 4 when 0 then concat('# Task 1', chr(10), 'Return pairs of people where age=5', chr(10), '# Task 2', chr(10), 'x') when 2 then concat('# Task 7', chr(10), 'The login form and names of pizzerias') else 'nothing' end"}),
    "checklist_paths": ("pages", {"unit_id": "cast(page_id as string)", "relative_path": "case when page_id % 8 = 2 then 'materials/dump_1.pcap' else 'README.md' end"}),
    "artifact_index": ("pages", {"unit_id": "cast(page_id as string)", "ref": "case when page_id % 16 = 6 then 'dump1.pcap' else 'other.txt' end", "text": "'only pizza a stands here'"}),
    "problem_rows": ("labels", {"row_number": "doc_id", "project_id": "concat('p', cast(doc_id % 7 as string))", "problem": "case doc_id % 5 when 0 then 'Ссылки' when 1 then 'опечатки и факты' when 2 then 'Актуальность' when 3 then 'Прочее' else 'логика' end", "details": "case doc_id % 5 when 0 then concat('1. Строка 12 - сломанная ссылка', chr(10), 'Решение:', chr(10), 'исправить') when 1 then concat('* 10-12 - опечатка', chr(10), '15 - неверно, example') when 2 then 'устарел стек' when 3 then null else 'Тип проблемы: x' end"}),
    "named_projects": ("labels", {"raw_project": "case doc_id % 4 when 0 then 'Proj A (1)' when 1 then 'proj_b.id_77 x' when 2 then 'zzz' else 'Proj' end"}),
    "project_units": ("labels", {"project_id": "case doc_id % 3 when 0 then 'u1' when 1 then 'u2' else 'u3' end", "name": "case doc_id % 3 when 0 then 'Proj A' when 1 then 'PROJ B' else 'other' end"}),
    "atomic_rows": ("labels", {"row_number": "cast(doc_id as int)", "`критерий_код`": "case when doc_id % 6 = 5 then '' else 'links' end", "`Текст кейса`": "concat(' case ', cast(doc_id as string))", "`Проект`": "'p'", "`Строка`": "case doc_id % 4 when 0 then '12' when 1 then ' 9 - 7 ' when 2 then 'x' else null end", "`Файл`": "case doc_id % 3 when 0 then ' a.md ; b.md' when 1 then '' else 'c.md' end", "`Оставить`": "case doc_id % 5 when 0 then 'Opinion?' when 1 then 'мнение' else 'defect' end"}),
    "audited": ("pages", {"unit_id": "cast(page_id % 50 as string)", "relative_path": "concat('README_', cast(page_id as string), '.md')", "kind": "'readme'", "text": "concat('# Title ', cast(page_id as string), chr(10), case page_id % 5 when 0 then 'TODO: describe' when 1 then 'A word is any symbol' when 2 then 'Look at http:/broken.example/x' when 3 then '![shot](img/none.png)' else 'Look at https://gone.example/x' end, chr(10), 'License: MIT')"}),
    "strict_gold": ("events", {"gold_idx": "event_id", "project_id": "cast(user_id as string)", "criterion": "event_type", "use_row": "event_id % 5 = 0", "gold_text": "case event_id % 4 when 0 then 'aaa bbb' when 1 then 'ccc' when 2 then '' else 'bbb aaa' end", "file_hint": "case when event_id % 2 = 0 then 'README.md' else null end", "line_start": "cast(case when event_id % 3 = 0 then null else event_id % 7 + 1 end as int)", "line_end": "cast(null as int)"}),
    "strict_found": ("events", {"pred_idx": "event_id", "project_id": "cast(user_id as string)", "criterion": "event_type", "use_row": "event_id % 5 in (1, 2)", "found_text": "case event_id % 3 when 0 then 'aaa bbb ccc' when 1 then 'ddd' else '' end", "file_path": "case event_id % 4 when 0 then 'readme_rus.md' when 1 then 'x.md' else null end", "line_start": "cast(event_id % 6 + 1 as int)", "line_end": "cast(null as int)"}),
    "image_files": ("pages", {"unit_id": "cast(page_id as string)", "relative_path": "'README.md'", "kind": "'readme'", "text": "case page_id % 3 when 0 then 'See ![a](img/x.png)' when 1 then 'From https://a.example ![a](img/x.png)' else '![a](img/logo.png)' end"}),
    "image_meta": ("pages", {"unit_id": "cast(page_id as string)", "relative_path": "'img/x.png'", "width": "800", "height": "600", "author": "case when page_id % 6 = 0 then 'me' else null end", "copyright": "cast(null as string)", "license": "cast(null as string)", "has_c2pa": "false"}),
    "unit_files": ("pages", {"path": "case when page_id % 2 = 0 then concat('p', cast(page_id % 7 as string), '/README.md') else concat('Q', cast(page_id % 7 as string), '/inner/src/a', cast(page_id as string), '.py') end", "length": "page_id"}),
    "license_files": ("pages", {"unit_id": "cast(page_id as string)", "relative_path": "case page_id % 6 when 0 then 'package.json' when 1 then 'app/pyproject.toml' when 2 then 'License.txt' when 3 then 'README.md' when 4 then 'package.json' else 'a.txt' end", "kind": "case when page_id % 6 = 3 then 'readme' else 'text' end", "text": "case page_id % 6 when 0 then '{\"license\": \"MIT\"}' when 1 then concat('[project]', chr(10), 'license = \"Apache-2.0\"') when 3 then 'Лицензия: MIT' when 4 then '{\"name\": \"license\"}' else 'license' end"}),
}
#: Rules of availability, in order: (pattern, status, reason).
AVAILABILITY = (("figma.com", "unavailable", "r"), ("*.slack.com", "limited", "r"), ("docker", "manual_review", "r"), ("notion", "wrong", "r"))


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = MADE[name]
    return t.table(spark, sf_dir, table).selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def image_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in notes about pages: ids, places and contexts."""
    x = entities.entities(made(spark, sf_dir, "image_notes"), ("image",))
    return x.select("entity_id", "unit_id", "value", "line_start", F.char_length("context").alias("n_context"))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in the form in which texts are compared."""
    x = normalize_for_match(F.coalesce("text", F.lit("")))
    return t.table(spark, sf_dir, "documents").select("doc_id", F.md5(x.cast("binary")).alias("md5"), F.char_length(x).alias("n_chars"))


def lines_outside_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_fences(made(spark, sf_dir, "fenced")).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("sum_lines"))


def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within task sections."""
    x = sticky_state(made(spark, sf_dir, "tasks"), context.TASK_SECTION, context.THEORY_SECTION)
    return x.groupBy("unit_id").agg(F.count(F.when(F.col("in_task"), 1)).alias("in_task"), F.count(F.lit(1)).alias("n"))


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_quality(made(spark, sf_dir, "pictures"), made(spark, sf_dir, "picture_sizes")).select("unit_id", "line_start", "issue_type", "severity", "verdict", "confidence")


def editorial_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of prose lines of documents, 12 a source at most."""
    return readability.editorial_windows(lines(t.files(spark, sf_dir))).select("unit_id", "relative_path", "batch", "first_line", "n_lines")


def word_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.word_definitions(made(spark, sf_dir, "definitions")).select("unit_id", "line_start", "quote", "confidence")


def table_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.table_mismatches(made(spark, sf_dir, "table_lines")).select("unit_id", "line_start", "quote")


def dependency_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rights.dependency_licenses(made(spark, sf_dir, "declared"), made(spark, sf_dir, "licenses").distinct()).select("unit_id", "quote", "severity", "verdict", "confidence")


def copied_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rights.copied_code(made(spark, sf_dir, "code_matches")).select("unit_id", "quote", "confidence")


def rights_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rights.rights_findings(made(spark, sf_dir, "risks"))
    return x.groupBy("issue_type", "severity", "verdict", "needs_human_review").agg(F.count(F.lit(1)).alias("n"))


def declared_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.candidates(made(spark, sf_dir, "manifests")).select("unit_id", "file_path", "ecosystem", "name", "spec", "line_start", "grp")


def dependency_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dependencies.freshness(dependencies.candidates(made(spark, sf_dir, "manifests")), made(spark, sf_dir, "registry").distinct())
    return x.select("unit_id", "file_path", "quote", "issue_type", "severity", "verdict", "confidence", "latest_version")


def regional_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(i, *r, None, None) for i, r in enumerate(AVAILABILITY)], "ord int, pattern string, status string, reason string, source string, updated_at string")
    return dependencies.availability(made(spark, sf_dir, "services"), rules).select("unit_id", "line_start", "support_status", "severity", "verdict", "confidence")


def technology_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.technology_candidates(entities.entities(page_notes(spark, sf_dir), ("version", "technology")))


def stored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = verdicts.verdict_rows(made(spark, sf_dir, "responses"))
    return x.groupBy("model", "verdict", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("sum_lines"))


def anchored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose quote stands in their line."""
    return verdicts.anchored(made(spark, sf_dir, "quoted"), made(spark, sf_dir, "event_lines")).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("sum_lines"))


def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = t.table(spark, sf_dir, "events").selectExpr("concat('m', cast(event_id % 3 as string)) as model", "event_id % 5 = 0 as cache_hit", "named_struct('prompt_tokens', event_id % 100, 'completion_tokens', event_id % 10, 'total_tokens', event_id % 100 + event_id % 10, 'cost_usd', cast(event_id % 8 as double) / 8) as usage")
    return verdicts.usage(x)


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro(evaluate.by_criterion(*_matches(spark, sf_dir)))


def cost_per_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hit costs, by type of event; null without one."""
    x = t.table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.col("event_id") % 10).alias("cost"), F.count(F.when((F.col("value") > 95) & (F.col("event_type") != "view"), 1)).alias("tp"))
    return x.select("event_type", evaluate.cost_quality(F.col("cost"), F.col("tp")).alias("cost_per_tp"))


def line_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = made(spark, sf_dir, "relations")
    return x.groupBy(evaluate.line_relation(*(F.col(c) for c in ("gs", "ge", "ps", "pe"))).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = made(spark, sf_dir, "artifact_texts")
    return x.where(evaluate.missing_artifact(F.col("gold"), F.col("found"))).groupBy("gold", "found").agg(F.count(F.lit(1)).alias("n"))


def opinions_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.opinions_dropped(made(spark, sf_dir, "opinion_cases")).select("gold_idx")


def issue_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = made(spark, sf_dir, "issues").select(adjudicate.issue_parts(F.col("issue")).alias("i"), adjudicate.location_parts(F.col("location")).alias("l"))
    return x.groupBy("i.quote", "i.defect", "i.fix", "i.subtype", "l.file_path", "l.line_range").agg(F.count(F.lit(1)).alias("n"))


def greedy_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs where gold rows and predictions compete: best score first, then the later gold row, then the later prediction."""
    x = made(spark, sf_dir, "rivals").groupBy("scope", "gold_idx", "pred_idx").agg(F.max("score").alias("score"))
    return matching.greedy(x, ["scope"], [("score", False), ("gold_idx", False), ("pred_idx", False)])


def postprocess_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = findings.warnings(findings.postprocessed(t.event_findings(spark, sf_dir))[1])
    return x.select("drop_reason", "n", F.size("examples").alias("n_examples"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's rows, with units named by a table."""
    units = t.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("unit_id"), F.concat(F.lit("unit "), F.col("user_id").cast("string")).alias("name")).distinct()
    x = sinks.report_rows(t.event_findings(spark, sf_dir), units)
    return x.groupBy("unit_name", "tier", "fragment", "location", "explanation", "source").agg(F.count(F.lit(1)).alias("n"))


def adjudication_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn false positives with empty columns for a reviewer."""
    return sinks.adjudication_sheet(adjudicate.stratified_sample(_subtypes(spark, sf_dir).select("finding_id", "subtype"), margin=0.1))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = made(spark, sf_dir, "cache_rows")
    return f.upserted(x.where("not is_fresh").drop("is_fresh"), x.where("is_fresh").drop("is_fresh"))


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.gold_rows(made(spark, sf_dir, "gold_sheet"))


def gold_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.read_gold_sheet(made(spark, sf_dir, "sheet_rows"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are text files that count, and of what kind."""
    p = F.col("path")
    return made(spark, sf_dir, "any_paths").groupBy("path", f.file_kind(p).alias("kind"), f.is_text_file(p).alias("is_text"), f.is_ignored(p).alias("is_ignored")).agg(F.count(F.lit(1)).alias("n"))


def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "roots").select("root", f.unit_id(F.col("root"), F.col("label")).alias("unit_id"))


def decoded_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "contents").select("page_id", f.decoded(F.col("content")).alias("text"))


def checklist_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklists.questions(made(spark, sf_dir, "checklist_files")).select("unit_id", "q_index", "name", "description", "problem")


def checklist_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check-lists of units against their READMEs."""
    asked = written(checklists.questions(made(spark, sf_dir, "checklist_files")))
    return checklists.alignment(asked, checklists.readmes(made(spark, sf_dir, "checklist_readmes"))).select("unit_id", "issue_type", "severity", "verdict", "confidence")


def checklist_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions demand beyond the README, the files and the artifacts."""
    asked = written(checklists.questions(made(spark, sf_dir, "checklist_files")))
    x = checklists.grounding(asked, checklists.readmes(made(spark, sf_dir, "checklist_readmes")), made(spark, sf_dir, "checklist_paths"), made(spark, sf_dir, "artifact_index"))
    return checklists.grounding_findings(x).select("unit_id", "issue_type", "quote", "severity", "verdict", "confidence")


def gold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single cases of a sheet's rows, with their criteria and lines."""
    return gold.gold_cases(made(spark, sf_dir, "problem_rows"))


def project_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.matched_projects(made(spark, sf_dir, "named_projects"), made(spark, sf_dir, "project_units").distinct())


def atomic_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.atomic_cases(made(spark, sf_dir, "atomic_rows"))


def _strict(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold cases and predictions of a user's events; several of each compete."""
    return made(spark, sf_dir, "strict_gold").where("use_row"), made(spark, sf_dir, "strict_found").where("use_row")


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pair_scores(*_strict(spark, sf_dir)).select("gold_idx", "pred_idx", "match_type", "score")


def strict_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per gold case: its match, its best free prediction, or neither."""
    cases, found = _strict(spark, sf_dir)
    return evaluate.strict_matches(cases, written(evaluate.pair_scores(cases, found))).select("gold_idx", "pred_idx", "match_type", "score", "counted")


def prescreened_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.prescreened(*_strict(spark, sf_dir)).select("gold_idx", "pred_idx", "same", F.round("score", 6).alias("score"), "rank")


def assigned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a project that the rules take for the same defect, one to one."""
    x = align.assigned(written(align.judged(align.prescreened(*_strict(spark, sf_dir)))))
    return x.select("gold_idx", "pred_idx", "same", F.round("confidence", 6).alias("confidence"))


STRICT_CHECKER = "case pred_idx % 3 when 0 then 'link_checker' when 1 then 'readability_checker' else 'market_fit_checker' end"


def evaluation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten tables of an evaluation, written as one commit and read back: how many rows each has."""
    cases, found = _strict(spark, sf_dir)
    bundle = sinks.Bundle(spark, scratch(spark))
    bundle.write(evaluate.evaluation(cases, found.withColumn("checker_name", F.expr(STRICT_CHECKER))))
    return reduce(DataFrame.unionAll, (x.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, x in bundle.tables().items()))


def evaluation_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of checkers, by groups of checkers and by criterion, from one table of matches."""
    cases, found = _strict(spark, sf_dir)
    tables = evaluate.evaluation(cases, found.withColumn("checker_name", F.expr(STRICT_CHECKER)))
    cols = ("kind", "name", "predicted_total", "true_positive", "false_positive", "precision")
    parts = [tables[t].withColumn("kind", F.lit(t)).withColumnRenamed(key, "name") for t, key in (("by_checker", "slice_name"), ("by_checker_group", "slice_name"), ("by_criterion", "criterion"))]
    return reduce(DataFrame.unionAll, (x.select(*cols) for x in parts))


def dependency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared dependencies that need a peer which isn't there, or another node than the project's."""
    registry = made(spark, sf_dir, "registry").select("ecosystem", "name").distinct().withColumns({
        "required_python": F.when(F.col("name") == "Flask", "<3"),
        "peer_dependencies": F.when(F.col("name") == "lib0", F.create_map(F.lit("react"), F.lit("^17.0"))),
        "engines": F.when(F.col("name") == "lib1", F.create_map(F.lit("node"), F.lit("<16"))),
    })
    x = dependencies.compatibility(dependencies.candidates(made(spark, sf_dir, "manifests")), registry)
    return x.select("unit_id", "quote", *(F.element_at("extra", k).alias(k) for k in ("related_dependency", "required_spec")), "severity", "confidence")


def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures without metadata and without a source nearby."""
    files = made(spark, sf_dir, "image_files")
    images = entities.entities(files, ("image",)).withColumn("target", F.col("value"))
    return rights.image_sources(images, files, made(spark, sf_dir, "image_meta")).select("unit_id", "quote", "severity", "verdict", "confidence")


def discovered_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.units(made(spark, sf_dir, "unit_files"))


def manifest_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units without a licence in files, README or manifests."""
    return rights.units_without_license(made(spark, sf_dir, "license_files")).select("unit_id", "severity", "verdict", "confidence")


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all detectors report about units made of pages, with a snapshot of link states."""
    states = spark.createDataFrame([("https://gone.example/x", 404, None, None)], "url string, status int, final_url string, error string")
    kept, _ = audit(Corpus(made(spark, sf_dir, "audited"), lookups={"url_status": states}))
    return kept.groupBy("checker_name", "issue_type", "severity", "verdict").agg(F.count(F.lit(1)).alias("n"))


# Lines that are put before a document's own, by its place in the corpus: what the fact rules look for, and what they leave out.
FACT_LINES = (
    "'## Theory'", "concat('Docker: the standard of ', source, ' since ', cast(1990 + doc_id % 40 as string), ' for all of its users')", "'The project is built and tested with the latest release of its standard tools'",
    "'See [here](https://example.org/a) for the standard of 2020 and more'", "'To run the latest release of the standard, install the tools of 2021 first'", "'A heading: of 2020 | the latest standard'", "'## Task 1'", "concat('The release of ', cast(doc_id as string), ' was published in 2020 by its own team')",
)


def fact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as README files of their source, whole, each with one of FACT_LINES before its text."""
    line = "case " + " ".join(f"when doc_id % {len(FACT_LINES)} = {i} then {x}" for i, x in enumerate(FACT_LINES)) + " end"
    return t.table(spark, sf_dir, "documents").where("text is not null").selectExpr("source as unit_id", "concat(cast(doc_id as string), '/', case when doc_id % 5 = 0 then 'README_RUS.md' when doc_id % 5 = 1 then 'notes.md' else 'readme.MD' end) as relative_path", "'readme' as kind", f"concat({line}, '\n', text) as text")


def readme_fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of documents, and of what stands before them, that state a fact or define a term."""
    return context.fact_lines(lines(fact_files(spark, sf_dir)), FACT_TECHNOLOGIES).select("unit_id", "relative_path", "line_no", F.md5("line").alias("line_md5"))


#: Without word borders, whose meaning differs between engines next to letters beyond ASCII.
FACT_TECHNOLOGIES = "(?i)(docker|postgresql|javascript)"


def readme_fact_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact lines in batches of 90, 8 of a unit."""
    x = context.fact_batches(lines(fact_files(spark, sf_dir)), technologies=FACT_TECHNOLOGIES)
    return x.select("unit_id", "batch", "relative_path", "line_start", "line_end", F.md5("text").alias("text_md5"), F.size("allowed_lines").alias("n_lines"))


# Items of models about the lines of documents: each fails one gate, or none, by the event that it belongs to.
GATE_ITEMS = {
    "item_id": "event_id", "unit_id": "source", "relative_path": "cast(doc_id as string)", "line": "case when event_id % 13 = 5 then 3 else 1 end",
    "checker_name": "case event_id % 6 when 0 then 'spelling_wording_checker' when 1 then 'curriculum_relevance_checker' when 2 then 'model_rubric_checker' when 3 then 'cross_file_consistency_checker' when 4 then 'readme_fact_actuality_checker' else 'other_checker' end",
    "issue_type": "case event_id % 5 when 0 then 'typo' when 1 then 'outdated_approach' when 2 then 'missing_key_topic' when 3 then 'wording' else 'style' end",
    "quote": "case when event_id % 17 = 3 then 'no such words' when event_id % 19 = 4 then '' else substr(split(text, '\n')[0], 1, 12) end", "criterion": "case when event_id % 7 = 1 then 'links' else 'correctness' end",
    "verdict": "case event_id % 8 when 0 then 'pass' when 1 then 'unknown' else 'fail' end", "confidence": "least(cast(1 as double), value / 100)", "evidence": "case when event_id % 9 = 0 then '' when event_id % 9 = 1 then 'the Makefile is old' else 'it is wrong' end", "recommendation": "'write it anew'",
}


def gated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gate of its checker each stored item fails, over the first lines of the documents that users' events point to."""
    docs = t.table(spark, sf_dir, "documents").where("text is not null")
    events = t.table(spark, sf_dir, "events")
    items = events.join(docs, events["user_id"] == docs["doc_id"]).selectExpr(*(f"{e} as {c}" for c, e in GATE_ITEMS.items()))
    shown = items.where("item_id % 11 <> 2 and line = 1").select("unit_id", "checker_name", "relative_path", "line")
    own = lines(docs.selectExpr("source as unit_id", "cast(doc_id as string) as relative_path", "'readme' as kind", "text"))
    return verdicts.gated(items, verdicts.line_ranges(shown), own).select("item_id", "checker_name", "gate")


def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested JSON report a document: its long lines as findings, with what follows each line as evidence."""
    docs = t.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", split_lines(F.col("text")).alias("own"))
    found = F.filter(F.transform("own", lambda x, i: F.struct(x.alias("line"), (i + 1).alias("no"))), lambda x: F.char_length(strip(x["line"])) > 260)

    def finding(x):
        detail = F.struct(F.lit("next").alias("title"), F.coalesce(F.get("own", x["no"]), F.lit("")).alias("detail"), F.lit(None).cast("string").alias("url"))
        return F.struct(
            F.concat_ws(":", F.col("doc_id").cast("string"), x["no"].cast("string")).alias("finding_id"), F.when(x["no"] % 7 == 6, "elsewhere").otherwise(F.col("source")).alias("unit_id"), F.lit("readability").alias("criterion"),
            F.when(x["no"] % 2 == 0, "link_checker").otherwise("readability_checker").alias("checker_name"), F.lit("minor").alias("severity"), F.when(x["no"] % 3 == 0, "fail").when(x["no"] % 3 == 1, "unknown").otherwise("warning").alias("verdict"),
            (F.pmod("doc_id", F.lit(10)) / 10).alias("confidence"), x["line"].alias("quote"), F.lit(" shorten it ").alias("recommendation"), F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), x["no"].alias("line_start"), x["no"].alias("line_end")).alias("location"),
            F.array(detail, detail, detail).alias("evidence"), F.create_map(F.lit("issue_type"), F.lit("long_line")).alias("extra"),
        )

    units = F.array(F.struct(F.col("source").alias("unit_id"), F.upper("source").alias("name")))
    return docs.select(F.col("doc_id").alias("report_no"), F.to_json(F.struct(units.alias("units"), F.transform(found, finding).alias("findings"))).alias("report"))


def flattened_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of nested reports as the predictions of an evaluation."""
    x = findings_json.predictions(json_reports(spark, sf_dir))
    return x.select("pred_idx", "finding_id", "project_id", "project", "checker_name", "line_start", "file_path", "verdict", "confidence", "issue_type", F.md5("found_text").alias("text_md5"))


def report_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From nested reports to the scores of an evaluation: strict signals, one-to-one matches with documents of low quality, precision and recall."""
    found = written(evaluate.strict_signals(findings_json.predictions(json_reports(spark, sf_dir))))
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("unit_id"))
    gold = t.table(spark, sf_dir, "labels").where("quality = 0").join(docs, "doc_id").select(F.col("doc_id").alias("gold_idx"), "unit_id", F.lit("readability").alias("criterion"), F.lit("minor").alias("severity"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit(None).cast("int").alias("line_start"))
    gold = written(gold)
    return evaluate.precision_recall(gold, found, evaluate.soft_matches(evaluate.soft_candidates(gold, found)))


QUERIES = {
    q.__name__: q
    for q in (
        image_entities, normalized_texts, lines_outside_fences, task_lines,
        small_images, editorial_windows, word_definitions, table_mismatches, dependency_licenses,
        copied_code, rights_ladder, declared_dependencies, dependency_freshness, regional_availability, technology_candidates,
        stored_verdicts, anchored_verdicts, model_usage, macro_metrics, cost_per_match, line_relations, missing_artifacts, opinions_dropped, issue_parts,
        greedy_rivals, postprocess_warnings, report_rows, adjudication_sheet, cache_upsert, gold_labels, gold_sheet, file_kinds, unit_ids, decoded_contents,
        checklist_questions, checklist_alignment, checklist_grounding, gold_cases, project_matches, atomic_gold, audit_counts,
        pair_scores, strict_matches, prescreened_pairs, assigned_pairs, dependency_conflicts, image_sources, discovered_units, manifest_licenses,
        evaluation_bundle, evaluation_slices, readme_fact_lines, readme_fact_batches, gated_verdicts, flattened_predictions, report_precision,
    )
}

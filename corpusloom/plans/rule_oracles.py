"""The queries of `rules` as DuckDB SQL. Rows are made by the same expressions; what a rule finds follows from the cases."""

from __future__ import annotations

from ..operators import context as c
from .oracles import FINDINGS, LINE_SPLIT, LINES, MATCHES, SUBTYPES
from .rules import AVAILABILITY, FACT_LINES, FACT_TECHNOLOGIES, GATE_ITEMS, MADE, STRICT_CHECKER


def made(*names: str) -> str:
    """CTEs of the rows that Spark makes."""
    out = []
    for name in names:
        table, columns = MADE[name]
        out.append(f"{name} as (select " + ", ".join(f"{e} as {c.replace('`', chr(34))}" for c, e in columns.items()) + f" from {table})")
    return ", ".join(out)


RELATION = """
case when gs is null or ps is null then 'none' when gs <= pe2 and ps <= ge2 then 'overlap' when least(abs(gs - pe2), abs(ps - ge2)) <= 2 then 'near' else 'far' end"""
SAMPLE = """
sized as (select subtype, count(*) as n from rows_in group by 1),
plan as (select subtype, case when n <= 10 then n else least(n, ceil(96.04 / (1 + (96.04 - 1) / n))) end as wanted from sized),
drawn as (select r.*, row_number() over (partition by r.subtype order by md5('42:' || cast(finding_id as varchar)), finding_id) as k from rows_in r)"""

SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}\p{{M}}_]+'))"


def folded(p: str) -> str:
    """A pattern of the JVM that doesn't look at case, for this engine."""
    return "(?i)" + p.removeprefix("(?iuU)")


# The rules' own patterns over whole texts; nothing here knows which line stands before a document.
POINTER, INNER = folded(c.POINTER), r"\[[^\]]+\]\(\s*#[^)]+\)"
FACTS = rf"""
files as (
  select source as unit_id, cast(doc_id as varchar) || '/' || case when doc_id % 5 = 0 then 'README_RUS.md' when doc_id % 5 = 1 then 'notes.md' else 'readme.MD' end as relative_path,
    (case {" ".join(f"when doc_id % {len(FACT_LINES)} = {i} then {x}" for i, x in enumerate(FACT_LINES))} end) || chr(10) || text as text from documents where text is not null
),
raw_lines as (select unit_id, relative_path, unnest({LINE_SPLIT}) as line, generate_subscripts({LINE_SPLIT}, 1) as line_no, len({LINE_SPLIT}) as total from files),
states as (
  select *, coalesce(last_value(case when regexp_matches(line, '{folded(c.THEORY_SECTION)}') then false when regexp_matches(line, '{folded(c.TASK_SECTION)}') then true end ignore nulls)
    over (partition by unit_id, relative_path order by line_no rows between unbounded preceding and current row), false) as in_task
  from raw_lines where not (line_no = total and line = '') and regexp_matches(relative_path, '{c.FACT_README}')
),
claims as (
  select *, {stripped("line")} as s, {stripped(f"regexp_replace(regexp_replace(regexp_replace({stripped('line')}, '^{SPACES}*(?:#{{1,6}}|[-*]|[0-9]+[.)]){SPACES}*', ''), '{chr(92)}[([^{chr(92)}]]+){chr(92)}]{chr(92)}(([^)]+){chr(92)})', '{chr(92)}1', 'g'), '{SPACES}+', ' ', 'g')")} as claim from states where not in_task
),
fact_lines as (
  select * from claims
  where s <> '' and s not like '#%' and not regexp_matches(s, '^\s*\|.+\|\s*$') and not regexp_matches(s, '{folded(c.FEEDBACK)}') and not regexp_matches(s, '{c.OPTION}')
    and not (regexp_matches(s, '{INNER}') and {words(f"regexp_replace(s, '{INNER}', '', 'g')")} <= 3)
    and not (regexp_matches(s, '{POINTER}') and {words(f"regexp_replace(s, '{POINTER}', '', 'g')")} <= 6)
    and not ({" or ".join(f"contains(' ' || lower(claim) || ' ', '{m}')" for m in c.REQUIREMENTS)})
    and not regexp_matches(claim, '{folded(c.LEADING)}') and not regexp_matches(claim, '{folded(c.SECOND_PERSON)}')
    and (regexp_matches(claim, '{c.FACT_DATE}') or not regexp_matches(claim, '{folded("|".join(c.LOCAL))}'))
    and (
      length(claim) between 35 and 520 and not regexp_matches(lower(claim), '^(https?://|!\[|\[)') and {words("claim")} >= 5
        and (regexp_matches(claim, '{c.FACT_DATE}') or regexp_matches(claim, '{folded(c.FACT)}') or regexp_matches(claim, '{FACT_TECHNOLOGIES}'))
      or length(claim) between 20 and 520 and regexp_matches(claim, '{c.DEFINITION}') and (regexp_matches(claim, '{folded(c.FACT)}') or regexp_matches(claim, '{FACT_TECHNOLOGIES}') or contains(claim, ':'))
    )
)"""
LONG_LINES = f"""
raw_lines as (select doc_id, source, {LINE_SPLIT} as own, unnest({LINE_SPLIT}) as line, generate_subscripts({LINE_SPLIT}, 1) as no, len({LINE_SPLIT}) as total from documents where text is not null),
kept as (select *, case when total > 0 and own[total] = '' then own[1:total - 1] else own end as lines from raw_lines where not (no = total and line = '')),
reported as (
  select *, row_number() over (partition by doc_id order by no) - 1 as n, case when no % 2 = 0 then 'link_checker' else 'readability_checker' end as checker_name,
    case no % 3 when 0 then 'fail' when 1 then 'unknown' else 'warning' end as verdict, cast(doc_id % 10 as double) / 10 as confidence, {stripped("coalesce(lines[no + 1], '')")} as following
  from kept where length({stripped("line")}) > 260
),
flat as (
  select *, doc_id * 4294967296 + n as pred_idx, concat_ws(' | ', {stripped("line")}, nullif(following, ''), nullif(following, ''), 'shorten it', 'long_line') as found_text from reported where no % 7 <> 6
)"""
GATE_SQL = "select " + ", ".join(f"{e.replace('split(text, ' + chr(39) + chr(92) + 'n' + chr(39) + ')[0]', 'split_part(text, chr(10), 1)')} as {n}" for n, e in GATE_ITEMS.items()) + ", text from events join documents on user_id = doc_id where text is not null"

ORACLE_SQL = {
    "readme_fact_lines": f"with {FACTS} select unit_id, relative_path, line_no, md5(line) as line_md5 from fact_lines",
    "readme_fact_batches": f"""
with {FACTS},
parts as (select *, (row_number() over (partition by unit_id, relative_path order by line_no) - 1) // 90 as part from fact_lines),
joined as (select unit_id, relative_path, part, min(line_no) as line_start, max(line_no) as line_end, count(*) as n_lines, md5(string_agg(cast(line_no as varchar) || ': ' || line, chr(10) order by line_no)) as text_md5 from parts group by 1, 2, 3),
placed as (select *, row_number() over (partition by unit_id order by lower(relative_path), relative_path, part) - 1 as batch from joined)
select unit_id, batch, relative_path, line_start, line_end, text_md5, n_lines from placed where batch < 8
""",
    "gated_verdicts": f"""
with items as ({GATE_SQL}),
shown as (select distinct unit_id, checker_name, relative_path from items where item_id % 11 <> 2 and line = 1),
x as (
  select i.*, s.unit_id is not null and line = 1 as inside, lower(concat_ws(' ', quote, evidence, recommendation)) as said, {LINE_SPLIT} as own from items i left join shown s on s.unit_id = i.unit_id and s.checker_name = i.checker_name and s.relative_path = i.relative_path
),
y as (
  select *, case checker_name
    when 'spelling_wording_checker' then case when confidence < 0.65 then 'confidence' when issue_type not in ('typo', 'tautology', 'case', 'wording', 'quote_style') then 'issue_type' when trim(quote) = '' or evidence = '' then 'text'
      when not inside then 'line' when not contains(own[line], quote) then 'quote' end
    when 'curriculum_relevance_checker' then case when confidence < case issue_type when 'outdated_approach' then 0.72 when 'missing_key_topic' then 0.74 else 0.55 end then 'confidence' when verdict = 'pass' then 'verdict'
      when criterion = 'links' then 'criterion' when issue_type = 'outdated_approach' and contains(said, 'makefile') and not (contains(said, ' java') or contains(said, 'java-') or contains(said, 'asp.net') or contains(said, 'c#')) then 'tooling' end
    when 'model_rubric_checker' then case when confidence < 0.7 then 'confidence' when verdict = 'unknown' then 'verdict' end
    when 'cross_file_consistency_checker' then case when confidence < 0.6 then 'confidence' end
    when 'readme_fact_actuality_checker' then case when not inside then 'line' end end as gate from x
),
z as (select *, row_number() over (partition by unit_id, checker_name, relative_path, substr(quote, 1, 160), gate is null order by item_id) as again from y)
select item_id, checker_name, case when checker_name = 'cross_file_consistency_checker' and gate is null and again > 1 then 'repeated' else gate end as gate from z
""",
    "flattened_predictions": f"""
with {LONG_LINES}
select pred_idx, cast(doc_id as varchar) || ':' || cast(no as varchar) as finding_id, source as project_id, upper(source) as project, checker_name, cast(no as integer) as line_start, cast(doc_id as varchar) || '.md' as file_path, verdict, confidence, 'long_line' as issue_type, md5(found_text) as text_md5 from flat
""",
    "report_precision": f"""
with {LONG_LINES},
strict as (select * from flat where not (verdict = 'unknown' and confidence < 0.8) and (checker_name <> 'link_checker' or verdict = 'fail')),
gold as (select l.doc_id from labels l join documents d on d.doc_id = l.doc_id where quality = 0),
n as (select (select count(*) from gold) as gold_total, (select count(*) from strict) as predicted_total, (select count(*) from gold where doc_id in (select doc_id from strict)) as true_positive)
select gold_total, predicted_total, true_positive, predicted_total - true_positive as false_positive, gold_total - true_positive as false_negative,
  round(true_positive / predicted_total, 4) as precision, round(true_positive / gold_total, 4) as recall, cast(0 as double) as critical_recall, round((predicted_total - true_positive) / predicted_total, 4) as false_positive_rate from n
""",
    "image_entities": f"""
with {made("image_notes")},
found as (
  select *, concat('img/', regexp_extract(relative_path, '[0-9]+'), '.png') as value, strpos(text, chr(10)) as cut from image_notes
),
both_lines as (select *, 4 as start, 1 as line_start from found union all select *, cut + 6, 2 from found)
select 'ent_' || substr(sha1(concat_ws('|', unit_id, relative_path, 'image', value, cast(start as varchar))), 1, 12) as entity_id, unit_id, value, line_start, length(text) as n_context from both_lines
""",
    "normalized_texts": """
select doc_id, md5(x) as md5, length(x) as n_chars from (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-zа-яё0-9]+', ' ', 'g')) as x from documents)
""",
    "lines_outside_fences": f"""
with {made("fenced")}, x as (select *, sum(case when line = '```' then 1 else 0 end) over (partition by unit_id order by line_no) % 2 as inside from fenced)
select unit_id, count(*) as n, cast(sum(line_no) as bigint) as sum_lines from x where line <> '```' and inside = 0 group by 1
""",
    "task_lines": f"""
with {made("tasks")},
x as (select *, last_value(case line when '## Theory' then false when '## Task 1' then true end ignore nulls) over (partition by unit_id order by line_no rows between unbounded preceding and current row) as state from tasks)
select unit_id, count(*) filter (coalesce(state, false)) as in_task, count(*) as n from x group by 1
""",
    "small_images": f"""
with {made("pictures", "picture_sizes")},
x as (select p.*, s.width, s.height from pictures p join picture_sizes s on p.unit_id = s.unit_id and p.value = s.relative_path)
select unit_id, line_start, case when width is null then 'unreadable_image' else 'small_image' end as issue_type, case when width is null then 'info' else 'minor' end as severity,
  case when width is null then 'unknown' else 'warning' end as verdict, cast(case when width is null then 0.45 else 0.85 end as double) as confidence
from x where width is null or ((width < 640 or height < 360) and value not like 'logo%' and not (width <= 128 and height <= 128))
""",
    "editorial_windows": f"""
with {LINES},
prose as (
  select unit_id, relative_path, line_no, regexp_replace(trim(line, chr(32) || chr(9)), '^#{{1,6}}\\s*', '') as line from lines
),
kept as (
  select *, (row_number() over (partition by unit_id, relative_path order by line_no) - 1) // 25 as batch from prose
  where line <> '' and not (line like '<!--%' or regexp_matches(line, '^[-*_=\\s]{{3,}}$') or regexp_matches(line, '^https?://\\S+$') or (line like '|%' and line like '%|'))
),
windows as (
  select unit_id, relative_path, batch, min(line_no) as first_line, count(*) as n_lines, string_agg(cast(line_no as varchar) || ': ' || line, chr(10) order by line_no) as text from kept group by 1, 2, 3
),
ranked as (
  select *, row_number() over (partition by unit_id order by relative_path, batch) as k from windows
  where length(regexp_replace(text, '[^A-Za-zА-Яа-яЁё]', '', 'g')) >= 80 and regexp_matches(text, '[.:;!?—-]')
)
select unit_id, relative_path, batch, first_line, n_lines from ranked where k <= 12
""",
    "word_definitions": f"""
with {made("definitions")}
select unit_id, line_no as line_start, case when line_no % 5 = 0 then 'Word is any symbol' else 'word is character' end as quote, cast(0.92 as double) as confidence from definitions where line_no % 5 in (0, 1)
""",
    "table_mismatches": f"""
with {made("table_lines")},
x as (select *, count(*) filter (line like 'The following%') over (partition by unit_id order by line_no rows between 8 preceding and 1 preceding) as lists from table_lines)
select unit_id, line_no as line_start, line as quote from x where line = '| id | name |' and lists > 0
""",
    "dependency_licenses": f"""
with {made("declared", "licenses")},
x as (select distinct d.unit_id, d.name, l.license_spdx as s from declared d join licenses l on d.name = l.name)
select unit_id, name as quote, case when s = 'GPL-3.0-only' then 'critical' else 'info' end as severity, case when s = 'GPL-3.0-only' then 'fail' else 'unknown' end as verdict,
  cast(case when s = 'GPL-3.0-only' then 0.9 else 0.55 end as double) as confidence
from x where s is null or s not in ('MIT', 'Apache-2.0')
""",
    "copied_code": f"with {made('code_matches')} select unit_id, other_unit_id as quote, similarity as confidence from code_matches where similarity >= 0.8 and not attributed",
    "rights_ladder": f"""
with {made("risks")}
select issue_type, case when deterministic then case risk when 'violation' then 'critical' when 'unlicensed' then 'major' when 'no_source' then 'minor' else 'info' end
    else case when risk in ('violation', 'unlicensed', 'no_source') then 'minor' else 'info' end end as severity,
  case when not deterministic then 'unknown' else case risk when 'violation' then 'fail' when 'unlicensed' then 'fail' when 'unverifiable' then 'unknown' else 'warning' end end as verdict,
  not deterministic or risk <> 'no_license_only' as needs_human_review, count(*) as n
from risks group by 1, 2, 3, 4
""",
    "declared_dependencies": f"""
with pages_in as (select *, cast(page_id % 20 as varchar) as unit_id, 'p' || cast(page_id as varchar) as folder from pages),
found as (
  select unit_id, folder || '/package.json' as file_path, 'npm' as ecosystem, 'lib' || cast(page_id % 7 as varchar) as name, '^1.' || cast(page_id % 5 as varchar) || '.0' as spec, 1 as line_start, 'dependencies' as grp from pages_in where page_id % 4 = 0
  union all select unit_id, folder || '/package.json', 'npm', 'node', '>=18', 1, 'engine' from pages_in where page_id % 4 = 0
  union all select unit_id, folder || '/requirements.txt', 'pypi', 'flask', '==2.' || cast(page_id % 6 as varchar), 2, 'requirements' from pages_in where page_id % 4 = 1
  union all select unit_id, folder || '/requirements.txt', 'pypi', 'numpy', '>=1.2', 3, 'requirements' from pages_in where page_id % 4 = 1
  union all select unit_id, folder || '/Dockerfile', 'docker', 'python', '3.' || cast(page_id % 8 as varchar), 1, 'base_image' from pages_in where page_id % 4 = 2
  union all select unit_id, folder || '/Dockerfile', 'docker', 'busybox', 'latest', 2, 'base_image' from pages_in where page_id % 4 = 2
  union all select unit_id, folder || '/pyproject.toml', 'pypi', 'python', '>=3.' || cast(page_id % 3 as varchar), 1, 'runtime' from pages_in where page_id % 4 = 3
  union all select unit_id, folder || '/pyproject.toml', 'pypi', 'requests', '>=2', 1, 'dependencies' from pages_in where page_id % 4 = 3
)
select unit_id, min(file_path) as file_path, ecosystem, name, spec, line_start, grp from found group by unit_id, ecosystem, name, spec, line_start, grp
""",
    "regional_availability": f"""
with {made("services")}, rules as (select * from (values {", ".join(f"({i}, '{p}', '{s}')" for i, (p, s, _) in enumerate(AVAILABILITY))}) as r(ord, p, status)),
x as (select unit_id, line_start, case value when 'https://www.figma.com/x' then 'figma.com' when 'Docker Hub' then 'docker' when 'api.slack.com' then '*.slack.com' end as p from services)
select x.unit_id, x.line_start, r.status as support_status, case r.status when 'unavailable' then 'major' when 'limited' then 'minor' else 'info' end as severity,
  case r.status when 'manual_review' then 'unknown' else 'warning' end as verdict, cast(0.85 as double) as confidence from x join rules r on r.p = x.p
""",
    "technology_candidates": """
select unit_id, value, file_path, 2 as line_start from (select cast(page_id % 20 as varchar) as unit_id, min('pages/' || cast(page_id as varchar) || '.md') as file_path from pages group by 1), (values ('Python'), ('Docker')) as v(value)
""",
    "stored_verdicts": """
with x as (select 'm' || cast(event_id % 3 as varchar) as model, event_id % 4 as way from events where event_id % 4 <> 3)
select model, case way when 0 then 'pass' when 1 then 'warning' else 'fail' end as verdict, cast(case way when 0 then 0.9 when 1 then 0.55 else 0.7 end as double) as confidence, count(*) as n,
  case when way = 2 then cast(3 * count(*) as bigint) end as sum_lines
from x group by model, way
""",
    "anchored_verdicts": """
select cast(user_id as varchar) as unit_id, count(*) as n, cast(sum(event_id) as bigint) as sum_lines from events where event_id % 3 = 0 and value / 10 >= 0.65 group by 1
""",
    "model_usage": """
with x as (select 'm' || cast(event_id % 3 as varchar) as model, event_id, event_id % 5 = 0 as hit from events),
y as (select * from x union all select 'all', event_id, hit from x)
select model, count(*) as calls, count(*) filter (hit) as cache_hits, cast(sum(event_id % 100) filter (not hit) as bigint) as prompt_tokens, cast(sum(event_id % 10) filter (not hit) as bigint) as completion_tokens,
  cast(sum(event_id % 100 + event_id % 10) filter (not hit) as bigint) as total_tokens, sum(cast(event_id % 8 as double) / 8) filter (not hit) as cost_usd
from y group by 1
""",
    "macro_metrics": f"""
with {MATCHES},
c as (
  select criterion, g, p, coalesce(tp, 0) as tp from (select coalesce(a.criterion, b.criterion) as criterion, coalesce(g, 0) as g, coalesce(p, 0) as p from
    (select criterion, count(*) as g from gold group by 1) a full join (select criterion, count(*) as p from pred group by 1) b on a.criterion = b.criterion) u
  left join (select criterion as mc, count(*) as tp from matches group by 1) m on u.criterion = m.mc
),
r as (select case when p = 0 then 0 else round(tp / p, 4) end as precision, case when g = 0 then 0 else round(tp / g, 4) end as recall from c)
select round(avg(precision), 4) as macro_precision, round(avg(recall), 4) as macro_recall, round(avg(case when precision + recall = 0 then 0 else round(2 * precision * recall / (precision + recall), 4) end), 4) as macro_f1 from r
""",
    "cost_per_match": "select event_type, cast(sum(event_id % 10) as double) / nullif(count(*) filter (value > 95 and event_type <> 'view'), 0) as cost_per_tp from events group by 1",
    "line_relations": f"""
with {made("relations")}, x as (select *, case when coalesce(ge, 0) = 0 then gs else ge end as ge2, case when coalesce(pe, 0) = 0 then ps else pe end as pe2 from relations)
select {RELATION} as relation, count(*) as n from x group by 1
""",
    "missing_artifacts": f"""
with {made("artifact_texts")}
select gold, found, count(*) as n from artifact_texts where (gold like 'Команда%' and found like 'pcap%') or (gold like 'tcpdump%' and found like 'the trace%') group by 1, 2
""",
    "opinions_dropped": "select event_id as gold_idx from events where event_id % 6 not in (0, 1)",
    "issue_parts": f"""
with {made("issues")},
x as (
  select case when issue is null or issue = 'case' then '' when issue like 'A B%' then 'A B' else split_part(issue, ' | ', 1) end as quote, issue, location from issues where not (coalesce(issue, '') like '%|%' and issue not like '% | %')
  union all select split_part(issue, '|', 1), issue, location from issues where issue like '%|%' and issue not like '% | %'
),
y as (
  select quote, case when issue like '%| fix it%' then split_part(issue, ' | ', 2) when issue like 'A B%' then 'Two Words' else '' end as defect,
    case when issue like '%| fix it%' then 'fix it | now' else '' end as fix,
    case when issue like '%| fix it%' then 'typo' when issue = 'case' then 'case' when issue is null or issue like 'A B%' then 'other' else split_part(issue, '|', 2) end as subtype,
    case location when 'a/b.md:10-12' then 'a/b.md' when 'c:d:7' then 'c:d' else location end as file_path, case location when 'a/b.md:10-12' then '10-12' when 'c:d:7' then '7' else '' end as line_range from x
)
select quote, defect, fix, subtype, file_path, line_range, count(*) as n from y group by 1, 2, 3, 4, 5, 6
""",
    "greedy_rivals": f"""
with recursive {made("rivals")},
pairs as (select scope, gold_idx, pred_idx, max(score) as score from rivals group by 1, 2, 3),
ordered as (select *, row_number() over (partition by scope order by score desc, gold_idx desc, pred_idx desc) as k from pairs),
walk as (
  select scope, cast(0 as bigint) as k, cast([] as bigint[]) as golds, cast([] as bigint[]) as preds, false as taken from pairs group by scope
  union all
  select o.scope, o.k, case when not list_contains(w.golds, o.gold_idx) and not list_contains(w.preds, o.pred_idx) then list_append(w.golds, o.gold_idx) else w.golds end,
    case when not list_contains(w.golds, o.gold_idx) and not list_contains(w.preds, o.pred_idx) then list_append(w.preds, o.pred_idx) else w.preds end,
    not list_contains(w.golds, o.gold_idx) and not list_contains(w.preds, o.pred_idx)
  from walk w join ordered o on o.scope = w.scope and o.k = w.k + 1
)
select o.scope, o.gold_idx, o.pred_idx, o.score from walk w join ordered o on o.scope = w.scope and o.k = w.k where w.taken
""",
    "postprocess_warnings": f"""
with {FINDINGS},
x as (
  select case when coalesce(support_status, '') = 'ошибка проверки' then 'tool_error'
    when checker_name in ('model_rubric_checker', 'tech_freshness_checker', 'readability_checker', 'spelling_wording_checker') and verdict = 'unknown' and confidence <= 0 and coalesce(source, '') = '' and trim(detail) = '' then 'empty_model_result'
    when checker_name = 'tech_freshness_checker' and criterion = 'technology_freshness' and verdict = 'unknown' and confidence < 0.3 and coalesce(source, '') = '' then 'low_evidence'
    when checker_name = 'model_rubric_checker' and criterion = 'rights' then 'rights_duplicate' end as drop_reason from findings
)
select drop_reason, count(*) as n, least(count(*), 3) as n_examples from x where drop_reason is not null group by 1
""",
    "report_rows": f"""
with {FINDINGS},
x as (
  select 'unit ' || unit_id as unit_name, case when severity in ('critical', 'major') or checker_name in ('link_checker', 'markdown_structure_checker', 'local_consistency_checker') then 'fix' else 'review' end as tier,
    coalesce(file_path || coalesce(':' || cast(line_start as varchar), ''), '') as location, trim(detail) as explanation, source from findings where verdict <> 'pass'
)
select unit_name, tier, location as fragment, location, explanation, source, count(*) as n from x group by 1, 2, 3, 4, 5, 6
""",
    "adjudication_sheet": f"with {SUBTYPES},{SAMPLE} select d.finding_id, d.subtype, '' as verdict, '' as note from drawn d join plan p on p.subtype = d.subtype where d.k <= p.wanted",
    "stratified_sample": f"with {SUBTYPES},{SAMPLE.replace('96.04', '384.16')} select d.finding_id, d.subtype, d.verdict from drawn d join plan p on p.subtype = d.subtype where d.k <= p.wanted",
    "cache_upsert": f"""
with {made("cache_rows")},
latest as (select * from (select *, row_number() over (partition by namespace, cache_key order by checked_at desc) as k from cache_rows where is_fresh) where k = 1)
select namespace, cache_key, checked_at, body from latest
union all select namespace, cache_key, checked_at, body from cache_rows c where not is_fresh and not exists (select 1 from latest l where l.namespace = c.namespace and l.cache_key = c.cache_key)
""",
    "gold_labels": """
with x as (select * from labels)
select cast(doc_id as varchar) as unit_id, case doc_id % 4 when 0 then 'links' when 1 then 'facts' when 2 then '' else 'image_quality' end as criterion,
  case doc_id % 3 when 0 then 'critical' else 'minor' end as severity, case when doc_id % 2 = 0 then 'README.md' end as file_path, cast(case doc_id % 4 when 0 then 12 when 1 then 7 end as integer) as line_start from x
""",
    "gold_sheet": """
select 'p' || cast(doc_id % 5 as varchar) as project, case when doc_id % 3 = 0 then '' else 'bad' end as problem, case when doc_id % 2 = 0 then '' else 'more' end as details, cast(doc_id + 2 as integer) as row_number
from labels where doc_id % 5 <> 0 and (doc_id % 3 <> 0 or doc_id % 2 <> 0)
""",
    "file_kinds": f"""
with {made("any_paths")}
select path, case path when 'docs/README_RUS.md' then 'readme' when 'check-list.yml' then 'checklist' when 'app/package.json' then 'dependency_manifest' when 'src/build/Dockerfile' then 'dependency_manifest'
    when 'Materials/a.md' then 'material' when 'tests/x.txt' then 'test' else 'text' end as kind,
  path <> 'src/main.py' as is_text, path like 'node_modules/%' or path like 'build/%' as is_ignored, count(*) as n from any_paths group by 1, 2, 3, 4
""",
    "unit_ids": f"""
with {made("roots")}
select root, case when root = '' then 'all-courses' when root like 'Courses%' then 'c-' || regexp_extract(root, '[0-9]+') when root = '--' then 'content' else root end || '__' || substr(sha1(case when root = '' then '.' else root end), 1, 8) as unit_id from roots
""",
    "decoded_contents": """
select page_id, case page_id % 3 when 0 then 'Привет' || chr(10) when 1 then 'Пр' || chr(10) || 'a' else 'a' || chr(65533) || chr(65533) || 'b' end as text from pages
""",
}
STRICT = f"""{made("strict_gold", "strict_found")},
both_sides as (
  select g.gold_idx, f.pred_idx, g.project_id, g.criterion as gold_criterion, f.criterion as found_criterion, g.line_start as gs, f.line_start as ps, g.gold_text, f.found_text, g.file_hint, f.file_path,
    case when g.gold_text = '' or f.found_text <> 'aaa bbb ccc' then 0 when g.gold_text = 'bbb aaa' then 1 else 0.95 end as text,
    case when g.line_start is null then 'none' when g.line_start = f.line_start then 'overlap' when abs(g.line_start - f.line_start) <= 2 then 'near' else 'far' end as relation
  from strict_gold g join strict_found f on g.project_id = f.project_id where g.use_row and f.use_row
)"""
SCORED = f"""{STRICT},
typed as (
  select *, case when relation = 'overlap' and text >= 0.25 then 'line_and_text' when relation = 'overlap' then 'line_overlap' when relation = 'near' and text >= 0.2 then 'near_line_and_text' when text >= 0.55 then 'text_similarity' else 'criterion_only' end as match_type
  from both_sides where gold_criterion = found_criterion
),
scored as (
  select gold_idx, pred_idx, project_id || ':' || gold_criterion as scope, match_type,
    cast(case match_type when 'line_overlap' then 0.82 when 'line_and_text' then greatest(0.9, text) when 'near_line_and_text' then greatest(0.75, text) when 'criterion_only' then greatest(0.15, text) else text end as double) as score from typed
)"""
SCREENED = f"""{STRICT},
rated as (
  select *, gold_criterion = found_criterion as same, coalesce(file_hint = 'README.md' and file_path = 'readme_rus.md', false) as same_file, relation in ('overlap', 'near') as close,
    case when gold_text = '' or found_text <> 'aaa bbb ccc' then 0 else 1 end as content from both_sides
),
ranked as (
  select *, cast(case when same_file and close then 0.9 when same_file and gs is null then 0.84 else content + case when close then 0.1 else 0 end end as double) as score from rated
),
screened as (select * from (select *, row_number() over (partition by gold_idx order by same desc, score desc, pred_idx) as rank from ranked where score >= 0.1) where rank <= 8)"""


def greedy(source: str) -> str:
    """CTEs walk and taken: `source` (scope, gold_idx, pred_idx, place) in order of place; a pair is taken if neither end was."""
    free = "not list_contains(w.golds, o.gold_idx) and not list_contains(w.preds, o.pred_idx)"
    return f"""walk as (
  select scope, cast(0 as bigint) as place, cast([] as bigint[]) as golds, cast([] as bigint[]) as preds, false as hit from {source} group by scope
  union all
  select o.scope, o.place, case when {free} then list_append(w.golds, o.gold_idx) else w.golds end, case when {free} then list_append(w.preds, o.pred_idx) else w.preds end, {free}
  from walk w join {source} o on o.scope = w.scope and o.place = w.place + 1
),
taken as (select o.* from walk w join {source} o on o.scope = w.scope and o.place = w.place where w.hit)"""


TAKEN = f"""{SCORED},
queue as (select *, row_number() over (partition by scope order by score desc, gold_idx, pred_idx) as place from scored where match_type <> 'criterion_only'),
{greedy("queue")},
golds as (select * from strict_gold where use_row),
finds as (select *, {STRICT_CHECKER} as checker, pred_idx in (select pred_idx from taken) as hit from strict_found where use_row and criterion in (select criterion from golds)),
gold_keys as (select distinct project_id, criterion from golds), found_keys as (select distinct project_id, criterion from strict_found where use_row)"""
ORACLE_SQL |= {
    "evaluation_bundle": f"""
with recursive {TAKEN}
select 'summary' as name, cast(1 as bigint) as n union all select 'main', count(*) from golds union all select 'by_criterion', count(distinct criterion) from golds
union all select 'overview_by_criterion', count(distinct criterion) from (select criterion from gold_keys union all select criterion from found_keys)
union all select 'by_checker', count(distinct checker) from finds union all select 'by_checker_group', count(distinct checker) from finds
union all select 'false_negative_analysis', count(*) from golds where gold_idx not in (select gold_idx from taken) union all select 'false_positive_detailed', count(*) from finds where not hit
union all select 'false_negative', count(*) from (from gold_keys except from found_keys) union all select 'false_positive', count(*) from (from found_keys except from gold_keys)
""",
    "evaluation_slices": f"""
with recursive {TAKEN},
sliced as (
  select 'by_checker' as kind, checker as name, hit from finds
  union all select 'by_checker_group', case checker when 'link_checker' then 'links_and_resources' when 'market_fit_checker' then 'methodology' else 'other' end, hit from finds
  union all select 'by_criterion', criterion, hit from finds
)
select kind, name, count(*) as predicted_total, count(*) filter (hit) as true_positive, count(*) filter (not hit) as false_positive, round(count(*) filter (hit) / count(*), 4) as precision from sliced group by 1, 2
""",
    "pair_scores": f"with {SCORED} select gold_idx, pred_idx, match_type, score from scored",
    "strict_matches": f"""
with recursive {SCORED},
queue as (select *, row_number() over (partition by scope order by score desc, gold_idx, pred_idx) as place from scored where match_type <> 'criterion_only'),
{greedy("queue")},
free as (
  select *, row_number() over (partition by gold_idx order by score desc, pred_idx) as k from scored where pred_idx not in (select pred_idx from taken) and gold_idx not in (select gold_idx from taken)
),
found as (select gold_idx, pred_idx, match_type, score, true as counted from taken union all select gold_idx, pred_idx, match_type, score, false from free where k = 1)
select g.gold_idx, f.pred_idx, coalesce(f.match_type, 'missed') as match_type, coalesce(f.score, 0) as score, coalesce(f.counted, false) as counted from strict_gold g left join found f on f.gold_idx = g.gold_idx where g.use_row
""",
    "prescreened_pairs": f"with {SCREENED} select gold_idx, pred_idx, same, round(score, 6) as score, rank from screened",
    "assigned_pairs": f"""
with recursive {SCREENED},
sure as (select gold_idx, pred_idx, project_id as scope, same, greatest(score, 0.9) as confidence from screened where score >= 0.82),
queue as (select *, row_number() over (partition by scope order by same desc, confidence desc, gold_idx, pred_idx) as place from sure),
{greedy("queue")}
select gold_idx, pred_idx, same, round(confidence, 6) as confidence from taken
""",
    "image_sources": "select cast(page_id as varchar) as unit_id, 'img/x.png' as quote, 'minor' as severity, 'warning' as verdict, cast(0.65 as double) as confidence from pages where page_id % 6 = 3",
    "discovered_units": f"""
with {made("unit_files")},
x as (select distinct case when path like 'p%' then split_part(path, '/', 1) else split_part(path, '/', 1) || '/inner' end as relative_path from unit_files)
select case when relative_path like 'p%' then relative_path else 'inner' end || '__' || substr(sha1(relative_path), 1, 8) as unit_id, case when relative_path like 'p%' then relative_path else 'inner' end as name, relative_path,
  case when relative_path like 'Q%' then split_part(relative_path, '/', 1) end as branch from x
""",
    "manifest_licenses": "select cast(page_id as varchar) as unit_id, 'info' as severity, 'warning' as verdict, cast(0.6 as double) as confidence from pages where page_id % 6 in (4, 5)",
    "checklist_questions": """
with p as (select cast(page_id as varchar) as unit_id, page_id % 4 as way from pages)
select unit_id, 0 as q_index, case way when 0 then 'Task 1: pairs' when 2 then 'Task 7 login form' end as name,
  case way when 0 then 'Check that the expected output is: select a from t where p1.id > p2.id and p1.age = 5'
    when 2 then '"Pizza A" "Pizza A" "Pizza A" must be the expected output of whoami, see the example capture dump1.pcap' end as description,
  case way when 1 then 'no_questions' when 3 then 'yaml_error' end as problem from p
union all select unit_id, 1, 'Task 2', 'short', null from p where way = 0
""",
    "checklist_alignment": """
select cast(page_id as varchar) as unit_id, case page_id % 4 when 1 then 'no_questions' when 3 then 'yaml_error' else 'checklist_alignment' end as issue_type,
  case page_id % 4 when 0 then 'minor' when 1 then 'major' when 2 then 'info' else 'critical' end as severity, case page_id % 4 when 0 then 'warning' when 2 then 'pass' else 'fail' end as verdict,
  cast(case page_id % 4 when 0 then 0.72 when 1 then 0.9 when 2 then 0.75 else 0.95 end as double) as confidence from pages
""",
    "checklist_grounding": """
with x as (
  select page_id, 'ungrounded_self_join_order' as issue_type, 'p1.id > p2.id' as quote from pages where page_id % 4 = 0
  union all select page_id, 'ungrounded_sql_condition', 'p1.age = 5' from pages where page_id % 4 = 0
  union all select page_id, 'suspicious_duplicate_name_result', 'Pizza A × 3' from pages where page_id % 4 = 2
  union all select page_id, 'ungrounded_command', 'whoami' from pages where page_id % 4 = 2 and page_id % 16 <> 6
  union all select page_id, 'artifact_missing_expected_text', 'whoami не найден в dump1.pcap' from pages where page_id % 16 = 6
  union all select page_id, 'expected_file_name_mismatch', 'dump1.pcap vs dump_1.pcap' from pages where page_id % 8 = 2
  union all select page_id, 'ungrounded_resource', 'dump1.pcap' from pages where page_id % 8 = 6
)
select cast(page_id as varchar) as unit_id, issue_type, quote, 'major' as severity, 'warning' as verdict, cast(case when issue_type like 'artifact%' then 0.88 else 0.84 end as double) as confidence from x
""",
    "gold_cases": f"""
with {made("problem_rows")},
x as (
  select *, 'links' as criterion, 1 as n, 12 as line_start, 'Строка 12 - сломанная ссылка' as gold_text from problem_rows where row_number % 5 = 0
  union all select *, 'readability', 1, null, '10-12 - опечатка' from problem_rows where row_number % 5 = 1
  union all select *, unnest(['readability', 'correctness']), 2, 15, '15 - неверно, example' from problem_rows where row_number % 5 = 1
  union all select *, 'technology_freshness', 1, null, 'устарел стек' from problem_rows where row_number % 5 = 2
  union all select *, unnest(['facts', 'correctness']), 1, null, 'Тип проблемы: x' from problem_rows where row_number % 5 = 4
)
select 'gold_' || cast(row_number as varchar) || '_' || criterion || '_' || cast(n as varchar) as case_id, row_number, project_id, criterion, line_start, line_start as line_end, gold_text from x
""",
    "project_matches": f"""
with {made("named_projects")}
select distinct raw_project, case raw_project when 'proj_b.id_77 x' then 'u2' when 'zzz' then null else 'u1' end as project_id, case raw_project when 'proj_b.id_77 x' then 'PROJ B' when 'zzz' then null else 'Proj A' end as matched_project,
  cast(case raw_project when 'zzz' then 0 when 'Proj' then 0.95 else 1 end as double) as score, raw_project = 'zzz' as weak from named_projects
""",
    "atomic_gold": """
select 'gold_' || cast(doc_id as varchar) || '_links' as case_id, cast(doc_id as integer) as row_number, 'p' as raw_project, 'links' as criterion, cast(case doc_id % 4 when 0 then 12 when 1 then 7 end as integer) as line_start,
  cast(case doc_id % 4 when 0 then 12 when 1 then 9 end as integer) as line_end, 'case ' || cast(doc_id as varchar) as gold_text, case doc_id % 3 when 0 then 'a.md' when 2 then 'c.md' end as file_hint, doc_id % 5 in (0, 1) as is_opinion
from labels where doc_id % 6 <> 5
""",
    "audit_counts": """
select * from (
  select 'structure_checker' as checker_name, 'missing_checklist' as issue_type, 'major' as severity, 'fail' as verdict, count(distinct page_id % 50) as n from pages
  union all select 'readability_checker', 'placeholder', 'major', 'fail', count(*) from pages where page_id % 5 = 0
  union all select 'local_consistency_checker', 'invalid_definition', 'minor', 'warning', count(*) from pages where page_id % 5 = 1
  union all select 'broken_url_syntax_checker', 'broken_url_syntax', 'major', 'fail', count(*) from pages where page_id % 5 = 2
  union all select 'local_link_checker', 'missing_local_image', 'major', 'fail', count(*) from pages where page_id % 5 = 3
  union all select 'link_checker', 'gone', 'major', 'fail', count(*) from pages where page_id % 5 = 4
) where n > 0
""",
}
#: Over candidates that the query above this one gives.
ORACLE_SQL["dependency_freshness"] = f"""
with declared as ({ORACLE_SQL["declared_dependencies"]}),
first_ones as (select *, row_number() over (partition by unit_id order by file_path, line_start, ecosystem, name, spec, grp) as k from declared),
x as (
  select *, case when ecosystem = 'npm' then '2.0.0' when name = 'flask' then '2.3' when ecosystem = 'docker' and name = 'python' then '3.5' end as latest_version from first_ones where k <= 50 and grp not in ('engine', 'runtime')
),
y as (
  select *, case when latest_version is null then 'no_snapshot' when ecosystem = 'npm' then 'checked' when name = 'flask' then case when cast(substr(spec, 5) as integer) < 3 then 'outdated' else 'checked' end
    when cast(substr(spec, 3) as integer) < 5 then 'outdated' else 'checked' end as rung from x
)
select unit_id, file_path, name || ' ' || spec as quote, rung as issue_type, case rung when 'outdated' then 'minor' else 'info' end as severity, case rung when 'no_snapshot' then 'unknown' when 'outdated' then 'warning' else 'pass' end as verdict,
  cast(case rung when 'no_snapshot' then 0.45 when 'outdated' then 0.85 else 0.75 end as double) as confidence, latest_version from y
"""
ORACLE_SQL["dependency_conflicts"] = f"""
with declared as ({ORACLE_SQL["declared_dependencies"]})
select unit_id, name || ' ' || spec as quote, case name when 'lib0' then 'react' else 'node' end as related_dependency, case name when 'lib0' then '^17.0' else '<16' end as required_spec, 'major' as severity, cast(0.8 as double) as confidence
from declared where name in ('lib0', 'lib1')
"""

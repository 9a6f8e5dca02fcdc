"""The queries of `planted` as DuckDB SQL: lines of the whole texts, read with the rules' own patterns."""

from __future__ import annotations

import re

from ..operators import align, consistency, context, curriculum, entities, markdown, readability, resources, rights, similarity
from .oracles import LINE_SPLIT, names
from .planted import ARTIFACTS, FILES, ROOTS
from .rule_oracles import SPACES, stripped, words

_LETTERS = r"\p{L}\p{M}\p{N}_"
START, END = f"(?:^|[^{_LETTERS}])", f"(?:$|[^{_LETTERS}])"


def rx(p: str) -> str:
    """A pattern of the JVM for this engine, as a string without looks around: borders of words know all letters, and take the character beyond them."""
    p = re.sub(r"\(\?<!\[(.*?)\]\)", r"(?:^|[^\1])", p)
    p = re.sub(r"\(\?!\[(.*?)\]\)", r"(?:$|[^\1])", p)
    out, inside = [], False
    for piece in re.findall(r"\\.|\(\?:|.", p, re.DOTALL):
        if piece == r"\b":
            # behind a character that isn't of a word, the border is before one that is
            piece = START if not out or out[-1] in ("|", "(", "(?:") else f"[{_LETTERS}]" if out[-1] in (r"\+", "#") else END
        elif piece == r"\w":
            piece = _LETTERS if inside else f"[{_LETTERS}]"
        elif piece == r"\s":
            piece = SPACES[1:-1] if inside else SPACES
        elif piece in "[]":
            inside = piece == "["
        out.append(piece)
    return "".join(out).replace("'", "''")


def said(x: str, p: str) -> str:
    return f"regexp_matches({x}, '(?i){rx(p)}')"


def within(p: str) -> str:
    """A pattern of whole words as one whose first group is what it finds."""
    core = p.removeprefix(r"\b").removesuffix(r"\b")
    return (START if p.startswith(r"\b") else "") + "(" + rx(core) + ")" + (END if p.endswith(r"\b") else "")


def matched_key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-zа-яё0-9]+', ' ', 'g'))"


def clipped(n: int, x: str) -> str:
    return f"substr({x}, 1, {n})"


FILE = "unit_id, relative_path"
BASE = f"""
own_files as (select {", ".join(f"{e} as {c}" for c, e in FILES.items())} from documents where text is not null),
paths as (select {FILE}, lower(relative_path) as low from own_files union all select {", ".join(f"{e} as {c}" for c, e in ARTIFACTS.items())}, lower({ARTIFACTS["relative_path"]}) from documents where text is not null),
cut as (select {FILE}, kind, {LINE_SPLIT} as own from own_files),
raw_lines as (select {FILE}, kind, unnest(own) as line, generate_subscripts(own, 1) as line_no, len(own) as total from cut),
all_lines as (select *, {stripped("line")} as s from raw_lines where not (line_no = total and line = '')),
open_lines as (
  select * from (select *, substr(s, 1, 3) in ('```', '~~~') as fence, sum(case when substr(s, 1, 3) in ('```', '~~~') then 1 else 0 end) over (partition by {FILE} order by line_no) % 2 as inside from all_lines)
  where not fence and inside = 0
)"""


def suffix(x: str) -> str:
    return f"regexp_extract({x}, '[.]([^./]+)$', 1)"


_EDITORIAL = [*((kind, within(p), "true", "0.88") for kind, p in readability.EDITORIAL), ("wording", within(readability.ASP_NET), "java", "0.9"), ("quote_style", "(" + rx(readability.CODE_QUOTE).replace(r"\"", '"') + ")", "contains(p, '`')", "0.82")]
_VALUE = "(not regexp_matches({c}, '(?i){prose}') and (substr({c}, 1, 1) in ({starts}) or regexp_matches({c}, '^[0-9]') or (len(regexp_split_to_array({c}, '{spaces}+')) <= {words} and length({c}) <= {size})))"


def _value(c: str, starts: tuple[str, ...], words: int, size: int) -> str:
    return _VALUE.format(c=c, prose=rx(markdown.PROSE), starts=", ".join("'" + s.replace("'", "''") + "'" for s in starts), spaces=SPACES, words=words, size=size)


_RANGE = rx(consistency.LENGTH_RANGE)
_URL = "(?i)https?://[^ \\t\\n\\x0B\\f\\r]+"
_NAMED = {"java": curriculum.JAVA, "c": curriculum.C_LANGUAGE, "cpp": curriculum.CPP, "csharp": curriculum.CSHARP}
HINTS = f"""
hints as (
  {" union ".join(f"select unit_id, '{n}' as language from own_files where {said('unit_id', p)}" for n, p in curriculum.NAMES)}
  {" ".join(f"union select unit_id, '{n}' from paths where {suffix('low')} in ({names(e)})" for n, e in curriculum.SUFFIXES)}
  {" ".join(f"union select unit_id, '{n}' from own_files where kind = 'readme' and {said(clipped(4000, 'text'), p)}" for n, p in _NAMED.items())}
)"""
_INSTRUCTION = r"(kind in ('readme', 'checklist', 'material', 'text') or regexp_matches(lower(relative_path), '[.](md|txt|ya?ml)$'))"
_KIND = "case " + " ".join(f"when regexp_matches(lower(quote), '{p}') then '{k}'" for p, k in (("pcap|capture|захват", "pcap"), ("вирту|virtual|образ|^vm$", "vm"), ("архив|archive", "archive"), ("дамп|dump", "dump"), ("картин|изображ|image|picture", "image"))) + " else 'dataset' end"


def _has(language: str) -> str:
    return f"list_contains(languages, '{language}')"


_SIGNALS = (
    (f"{said('s', curriculum.CPP_STYLE)} and {_has('java')}", "language_material_conflict", "major", "correctness", "true"),
    (f"{said('s', curriculum.CPP_STYLE)} and {_has('c')} and not {_has('cpp')}", "language_material_conflict", "minor", "correctness", "true"),
    (f"{said('s', curriculum.ASP_NET)} and {_has('java')}", "inappropriate_tool", "major", "correctness", "true"),
    (f"{said('s', curriculum.MAKEFILE)} and {_has('java')} and not {said('s', curriculum.JAVA_BUILD)}", "language_tooling_conflict", "minor", "correctness", "true"),
    (said("s", curriculum.C_STANDARD), "outdated_approach", "minor", "technology_freshness", "false"),
    (said("s", curriculum.REVIEW), "topic_review", "info", "correctness", "false"),
    (said("s", curriculum.NO_GOTO), "absolute_practice_claim", "minor", "correctness", "true"),
)
_TOPICS = (
    (f"regexp_matches(code, '(?m)^{SPACES}*#{SPACES}*(?:define|include)(?:$|[^{_LETTERS}])') and not {said('said', curriculum.EXPLAINED)} and not {said('said', curriculum.EXPLAINING)}", "preprocessor", "minor"),
    (f"{said('said', curriculum.NUMBERS)} and {said('said', curriculum.TYPES)} and not {said('said', curriculum.UNSIGNED)}", "unsigned_types", "minor"),
    (f"(contains(lower(said), 'gcc') or contains(lower(said), 'компил')) and len(regexp_extract_all(said, '(?i){rx(curriculum.STEPS)}')) >= 3 and not {said('said', curriculum.DEBUGGER)}", "debugger", "info"),
    (f"{said('concat(said, chr(10), code)', curriculum.GAME)} and not {said('said', curriculum.STATES)}", "state_machine", "info"),
)
_ANY = lambda words: " or ".join(f"contains(low, '{w}')" for w in words)
_MARKET = {n: f"coalesce(bool_or({said('low', a)} or {said('low', b)}), false)" for n, (a, b) in context.MARKET.items()}
_ISSUE_TEXT = lambda x: f"regexp_replace({stripped(f'''regexp_replace(regexp_replace(lower({x}), 'https?:[/{chr(92)}{chr(92)}]+', ' ', 'g'), '[`*_\"{chr(39)}{chr(39)}«»(){chr(92)}[{chr(92)}]{{}}:;,.!?/{chr(92)}{chr(92)}|]+', ' ', 'g')''')}, '{SPACES}+', ' ', 'g')"

# Spaces stand twice while names of files are sought, as a match takes the characters on both sides of a name.
_REFS = rx(resources.FILE_REF)
_NAME = stripped("replace(coalesce(nullif(one[i], ''), two[i]), '  ', ' ')")
_NAMES = f"list_distinct(list_filter(list_transform(range(1, len(one) + 1), lambda i : regexp_replace({_NAME}, '^[.,;)]+|[.,;)]+$', '', 'g')), lambda r : r <> ''))"


def last_place(p: str) -> str:
    """Where the last match of a rule begins in `before`; -1 without one."""
    return f"case when {said('before', p)} then length(regexp_extract(before, '(?is)^(.*)(?:{rx(p)})', 1)) else -1 end"


_ENDINGS = "case " + " ".join(f"when w like '%{e}' and length(w) - {len(e)} >= 4 then substr(w, 1, length(w) - {len(e)})" for e in sorted(align.SUFFIXES, key=len, reverse=True)) + " else w end"


def stems(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({_ISSUE_TEXT(x)}, ' '), lambda w : length(w) > 2 and w not in ({names(align.STOPWORDS)})), lambda w : {_ENDINGS}))"


_POINTER, _INNER = f"(?i){rx(context.POINTER)}", r"\[[^\]]+\]\(\s*#[^)]+\)"
_ASKED = " or ".join(f"contains(' ' || lower(claim) || ' ', '{m}')" for m in context.REQUIREMENTS)
_CLAIM = stripped(f"regexp_replace(regexp_replace(regexp_replace({stripped('part')}, '^{SPACES}*(?:#{{1,6}}|[-*]|[0-9]+[.)]){SPACES}*', ''), '{chr(92)}[([^{chr(92)}]]+){chr(92)}]{chr(92)}(([^)]+){chr(92)})', '{chr(92)}1', 'g'), '{SPACES}+', ' ', 'g')")

ORACLE_SQL = {
    "editorial_findings": f"""
with {BASE},
prose as (
  select o.*, regexp_replace(s, '^#{{1,6}}{SPACES}*', '') as p, exists (select 1 from own_files f where f.unit_id = o.unit_id and lower(f.relative_path) like '%.java') as java from open_lines o
),
kept as (select * from prose where p <> '' and not (p like '<!--%' or regexp_matches(p, '^[-*_={SPACES[1:]}{{3,}}$') or regexp_matches(p, '^https?://[^ ]+$') or (p like '|%' and p like '%|'))),
hits as ({" union all ".join(f"select *, {i} as rule_no, '{kind}' as issue_type, regexp_extract(p, '(?i){regex}', 1) as quote, cast({c} as double) as confidence from kept where {on} and regexp_matches(p, '(?i){regex}')" for i, (kind, regex, on, c) in enumerate(_EDITORIAL))}),
ranked as (select *, row_number() over (partition by {FILE}, line_no, issue_type, {matched_key("quote")} order by rule_no) as k from hits)
select unit_id, relative_path as file_path, cast(line_no as integer) as line_start, issue_type, quote, confidence from ranked where k = 1
""",
    "chapter_sequence": f"""
with {BASE},
titled as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace({stripped(f"regexp_extract(s, '^(#{{1,6}}){SPACES}+(.+?){SPACES}*#*{SPACES}*$', 2)")}, '`([^`]+)`', '{chr(92)}1', 'g'), '{chr(92)}[([^{chr(92)}]]+){chr(92)}]{chr(92)}([^)]+{chr(92)})', '{chr(92)}1', 'g'), '{SPACES}+', ' ', 'g'), '^[ #]+|[ #]+$', '', 'g') as title
  from open_lines where regexp_matches(s, '^#{{1,6}}{SPACES}+.')
),
numerals as (select *, list_transform(regexp_extract_all(upper(regexp_extract(title, '(?i){rx(markdown.CHAPTER)}', 1)), '.'), lambda c : case c {" ".join(f"when '{d}' then {v}" for d, v in markdown.ROMAN)} end) as v from titled where {said("title", markdown.CHAPTER)}),
chapters as (select *, list_sum(list_transform(v, lambda x, i : case when x < coalesce(list_max(v[i + 1:]), 0) then -x else x end)) as chapter from numerals),
x as (select *, lag(chapter) over w as before, lag(line_no) over w as first_line from chapters window w as (partition by {FILE} order by line_no))
select unit_id, relative_path as file_path, cast(line_no as integer) as line_start, title as quote, cast(coalesce(first_line, line_no) as integer) as first_line from x
where (before is null and chapter <> 1) or (before is not null and chapter <> before and chapter <> before + 1)
""",
    "label_punctuation": f"""
with {BASE},
x as (select *, regexp_matches(line, '(?i){rx(markdown.LABEL)}') as is_label, {stripped(f"regexp_extract(line, '(?i){rx(markdown.LABEL)}', 2)")} as rest from open_lines),
y as (select *, {", ".join(f"lead(s, {k}) over w as s{k}, lead(is_label, {k}) over w as l{k}" for k in (1, 2, 3))} from x window w as (partition by {FILE} order by line_no)),
z as (select *, case when s1 <> '' then s1 when s2 <> '' then s2 when s3 <> '' then s3 end as following, case when s1 <> '' then l1 when s2 <> '' then l2 when s3 <> '' then l3 end as next_label from y where is_label and not regexp_matches(rest, '^[:：]'))
select unit_id, relative_path as file_path, cast(line_no as integer) as line_start, substr(s, 1, 320) as quote, cast(0.92 as double) as confidence from z
where case when rest <> '' then not {said("rest", markdown.PROSE)} and ({_value("rest", markdown.VALUE_START, 4, 80)} or contains(rest, '\\n') or contains(rest, '/'))
  else coalesce(not next_label and {_value("following", markdown.NEXT_START, 6, 120)}, false) end
""",
    "length_conflicts": f"""
with {BASE},
hits as (select *, unnest(h) as hit, generate_subscripts(h, 1) as n from (select *, regexp_extract_all(line, '(?i){_RANGE}') as h from all_lines where {said("line", consistency.FUNCTION)})),
ends as (select *, cast(regexp_extract(hit, '(?i){_RANGE}', 1) as integer) as a, cast(regexp_extract(hit, '(?i){_RANGE}', 2) as integer) as b from hits),
x as (select *, (least(a, b), greatest(a, b)) as own, row_number() over w as k, first_value((least(a, b), greatest(a, b))) over w as head, first_value(s) over w as head_text from ends window w as (partition by unit_id order by relative_path, line_no, n)),
other as (select *, row_number() over (partition by unit_id order by k) as place from x where own <> head)
select unit_id, relative_path as file_path, cast(line_no as integer) as line_start, substr(head_text, 1, 140) || ' / ' || substr(s, 1, 140) as quote from other where place = 1
""",
    "unconfirmed_paths": f"""
with {BASE},
hits as (select *, regexp_replace(unnest(regexp_extract_all(s, '{rx(resources.ENVIRONMENT_PATH).replace(")/(?:opt", ")(/(?:opt", 1)})', 1)), '[.,;)]+$', '') as quote from all_lines where not regexp_matches(s, '{_URL}'))
select distinct unit_id, relative_path as file_path, cast(line_no as integer) as line_start, quote, 'warning' as verdict, cast(0.82 as double) as confidence from hits
where unit_id not in (select unit_id from paths where {suffix("low")} in ({names(resources.ENVIRONMENT)}))
""",
    "resources_without_artifact": f"""
with {BASE},
hits as (
  select *, regexp_extract(s, '(?i){rx(resources.GENERIC)}', 1) as quote from all_lines
  where {said("s", resources.GENERIC)} and {said("s", resources.REQUIRED)} and not regexp_matches(s, '{_URL}') and not regexp_matches(s, '{rx(resources.ENVIRONMENT_PATH)}') and not {said("s", resources.FILE_REF)}
),
there as ({" union ".join(f"select unit_id, '{k}' as kind from paths where {suffix('low')} in ({names(e)})" for k, e in resources.KINDS.items())}),
needed as (select *, {_KIND} as resource from hits)
select unit_id, relative_path as file_path, cast(line_no as integer) as line_start, quote, 'warning' as verdict, cast(0.78 as double) as confidence from needed n
where not exists (select 1 from there t where t.unit_id = n.unit_id and t.kind = n.resource)
""",
    "call_outputs": f"""
with {BASE},
calls as (
  select *, case when regexp_matches(relative_path, '{context.README}') then 0 else 1 end as rank, {stripped(f"regexp_extract(line, '{context.CALL}', 3)")} as raw,
    regexp_extract(line, '{context.CALL}', 1) || '(' || regexp_replace(regexp_extract(line, '{context.CALL}', 2), '\\s+', '', 'g') || ')' as call
  from all_lines where regexp_matches(line, '{context.CALL}') and (regexp_matches(relative_path, '{context.README}') or {suffix("lower(relative_path)")} in ({names(context.CODE)}))
),
clean as (select *, {stripped("regexp_replace(raw, '^`+|`+$', '', 'g')")} as bare from calls where length(raw) between 1 and 200),
first_ones as (select *, row_number() over (partition by unit_id, call, relative_path order by line_no) as k from clean),
parsed as (
  select *, case when contains(bare, '{{') and regexp_matches(bare, '[0-9]+\\s*:\\s*-?[0-9]+') then 'map:' || array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(bare, '[0-9]+\\s*:\\s*-?[0-9]+'), lambda p : regexp_replace(p, '\\s+', '', 'g')))), ',')
    else 'str:' || regexp_replace(regexp_replace(lower(bare), '^[''"`{{}}() ]+|[''"`{{}}() ]+$', '', 'g'), '\\s+', '', 'g') end as output from first_ones where k = 1
),
g as (select unit_id, call, min((rank, relative_path, line_no, raw)) as a from parsed group by 1, 2 having count(distinct output) > 1)
select unit_id, a[2] as file_path, cast(a[3] as integer) as line_start, substr(a[4], 1, 160) as quote, call from g
""",
    "foreign_materials": f"""
with {BASE},
sources as (
  select unit_id, case {suffix("low")} {" ".join(f"when '{e}' then '{n}'" for e, n in context.SOURCE_LANGUAGES.items())} end as language from paths where not contains(low, 'test') and regexp_extract(low, '[^/]+$') not in ('build.py', 'conftest.py', 'setup.py', 'add_args.py')
),
spoken as (select unit_id, language, row_number() over (partition by unit_id order by count(*) desc, language) as k from sources where language is not null group by unit_id, language),
hits as ({" union all ".join(f"select *, '{tech}' as tech from all_lines where regexp_matches(relative_path, '{context.INSTRUCTION}') and {said('line', p)}" for tech, p in context.MATERIALS)}),
x as (select h.*, u.language, row_number() over (partition by h.unit_id, h.relative_path, h.tech order by h.line_no) as place from hits h join spoken u on u.unit_id = h.unit_id and u.k = 1 where h.tech <> u.language and (h.tech, u.language) not in ({", ".join(f"('{a}', '{b}')" for a, b in context.COVERED)}))
select unit_id, relative_path as file_path, cast(line_no as integer) as line_start, substr(s, 1, 160) as quote, tech, language from x where place = 1
""",
    "curriculum_signals": f"""
with {BASE},{HINTS},
known as (select unit_id, list(language) as languages from hints group by 1),
spoken as (
  select l.*, list_concat(coalesce(k.languages, []), list_filter([{", ".join(f"case when {said('s', p)} then '{n}' end" for n, p in _NAMED.items())}], lambda v : v is not null)) as languages
  from all_lines l left join known k on k.unit_id = l.unit_id where s <> '' and {_INSTRUCTION}
),
hits as ({" union all ".join(f"select *, {i} as rule_no, '{kind}' as issue_type, '{severity}' as severity, '{criterion}' as criterion, {strong} as strong from spoken where {on}" for i, (on, kind, severity, criterion, strong) in enumerate(_SIGNALS))}),
ranked as (select *, row_number() over (partition by {FILE}, line_no, issue_type order by rule_no) as k from hits)
select unit_id, relative_path, cast(line_no as integer) as line_no, issue_type, severity, criterion, strong from ranked where k = 1
""",
    "missing_topics": f"""
with {BASE},{HINTS},
own as (
  select *, {_INSTRUCTION} as told, case kind when 'readme' then 0 when 'checklist' then 1 when 'material' then 2 else 3 end as rank, {suffix("lower(relative_path)")} in ('c', 'h') as in_c, list_transform(string_split(text, chr(10)), lambda v : {stripped("v")}) as told_lines
  from own_files where unit_id in (select unit_id from hints where language = 'c')
),
placed as (select *, case when told then list_position(list_transform(told_lines, lambda v : v <> '' and v not like '#%'), true) end as place from own),
x as (
  select unit_id, coalesce(string_agg(case when told then text end, chr(10) order by relative_path), '') as said, coalesce(string_agg(case when in_c then substr(text, 1, 2000) end, chr(10) order by relative_path), '') as code,
    min((rank, relative_path, place, told_lines[place])) filter (place > 0) as anchor
  from placed group by 1 having count(*) filter (place > 0) > 0
),
topics as ({" union all ".join(f"select *, '{topic}' as topic, '{severity}' as severity from x where {on}" for on, topic, severity in _TOPICS)})
select unit_id, anchor[2] as file_path, cast(anchor[3] as integer) as line_start, substr(anchor[4], 1, 320) as quote, severity, topic from topics
""",
    "market_fit": f"""
with {BASE},
told as (select unit_id, lower(s) as low from all_lines where kind in ('readme', 'material', 'text') and s <> ''),
flags as (select unit_id, {", ".join(f"{e} as {n}" for n, e in _MARKET.items())} from told where not (({_ANY(context.TECHNICAL)}) and not ({_ANY(context.BUSINESS)})) group by 1),
sets as (
  select distinct unit_id from paths where regexp_matches(low, '[.](csv|xlsx|parquet|jsonl)$') and not regexp_matches(low, '{rx(context.NOISE_PATH)}') and (regexp_matches(low, '(^|/)(data|dataset|datasets)/') or regexp_matches(low, '{context.DATA_NAME}'))
),
x as (
  select coalesce(f.unit_id, s.unit_id) as unit_id, cast(coalesce(real_data, false) or s.unit_id is not null as int) + cast(coalesce(business_context, false) as int) + cast(coalesce(success_metrics, false) as int) as score
  from flags f full join sets s on s.unit_id = f.unit_id
)
select unit_id, score, case when score = 3 then 'info' else 'minor' end as severity, case when score = 3 then 'pass' else 'warning' end as verdict, round(cast(0.65 as double) + cast(0.1 as double) * score, 6) as confidence from x where score > 0
""",
    "dataset_terms": f"""
with {BASE},
hits as (select *, regexp_extract(text, '(?i){within(rights.DATASET)}', 1) as quote from own_files where {said("text", rights.DATASET)}),
near as (select *, strpos(lower(text), lower(quote)) as place, greatest(1, strpos(lower(text), lower(quote)) - 300) as b from hits),
x as (select *, row_number() over (partition by unit_id order by relative_path) as k from near where not regexp_matches(substr(text, b, place - b + length(quote) + 300), '(?i){rx(similarity.ATTRIBUTION)}'))
select unit_id, relative_path as file_path, quote, cast(0.7 as double) as confidence from x where k <= 5
""",
    "text_anchors": f"""
with {BASE},
found as (
  select relative_path, list_transform(regexp_extract_all(text, '{rx(align.URL).replace(chr(92) + chr(34), chr(34))}'), lambda u : regexp_replace(regexp_replace(regexp_replace(lower(u), '[.,);{chr(92)}]>]+$', ''), 'https?:[/{chr(92)}{chr(92)}]+', 'https://', 'g'), '/+$', '')) as urls,
    list_transform(regexp_extract_all(text, '(?i){rx(align.FILE.removeprefix("(?iU)"))}'), lambda f : lower(regexp_extract(f, '[^/]*$'))) as files,
    list_filter(list_transform(regexp_extract_all(text, '{align.QUOTE.replace(chr(39), chr(39) * 2)}', 1), lambda q : {_ISSUE_TEXT("q")}), lambda q : contains(q, ' ')) as phrases
  from own_files
)
select relative_path, {", ".join(f"coalesce(array_to_string(list_filter({c}, lambda v, i : list_position({c}, v) = i), ' | '), '') as {c}" for c in ("urls", "files", "phrases"))} from found
""",
    "missing_resources": f"""
with {BASE},
sought as (select *, regexp_extract_all(replace(s, ' ', '  '), '(?i){_REFS}', 1) as one, regexp_extract_all(replace(s, ' ', '  '), '(?i){_REFS}', 2) as two from all_lines),
refs as (select *, unnest({_NAMES}) as ref from sought where len(one) > 0),
keyed as (
  select *, lower(replace(trim(ref), '{chr(92)}', '/')) as key, regexp_extract(lower(replace(trim(ref), '{chr(92)}', '/')), '[^/]*$') as base, regexp_matches(s, '{_URL}') as linked, strpos(lower(s), lower(ref)) as place from refs
),
there as (
  select unit_id, unnest([key, base]) as name from keyed where linked or ((kind = 'readme' or lower(regexp_extract(relative_path, '[^/]*$')) like 'readme%') and {said("s", resources.EXTERNAL)})
  union select unit_id, unnest([low, regexp_extract(low, '[^/]*$')]) from paths
),
asked as (
  select *, substr(lower(s), greatest(0, place - 121) + 1, place - 1 - greatest(0, place - 121)) as before, substr(lower(s), place, length(ref) + 80) as after from keyed where not linked and {said("s", resources.REQUIRED)}
),
judged as (select *, {last_place(resources.OUTPUT)} as made, {last_place(resources.REQUIRED)} as given from asked)
select unit_id, relative_path as file_path, cast(line_no as integer) as line_start, ref as quote, 'fail' as verdict, cast(0.9 as double) as confidence from judged j
where not (made >= 0 and made >= given and not contains(after, 'expected') and not contains(after, 'ожида')) and not exists (select 1 from there t where t.unit_id = j.unit_id and t.name in (j.key, j.base))
""",
    "environment_guides": f"""
with {BASE}
select unit_id, min(relative_path) as file_path, regexp_extract(min(relative_path), '[^/]*$') as quote, cast(0.84 as double) as confidence from paths
where {said("regexp_extract(relative_path, '[^/]*$')", resources.GUIDE)} and unit_id not in (select unit_id from paths where {suffix("low")} in ({names(resources.ENVIRONMENT)})) group by unit_id
""",
    "unit_structure": f"""
with {BASE},
own as (select unit_id, low from paths union all select {ROOTS["unit_id"]}, lower({ROOTS["relative_path"]}) from documents where text is not null),
x as (select unit_id, bool_or(regexp_matches(low, '^readme.*[.]md$')) as readme, bool_or(regexp_matches(low, '^check-list.*[.]ya?ml$')) as checklist from own group by 1)
select unit_id, 'readability' as criterion, 'missing_readme' as issue_type, 'major' as severity, 'fail' as verdict, cast(0.95 as double) as confidence from x where not readme
union all select unit_id, 'checklist_alignment', 'missing_checklist', 'major', 'fail', 0.95 from x where not checklist
""",
    "missing_images": f"""
with {BASE},
newlines as (select {FILE}, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from own_files),
images as (select *, unnest(regexp_extract_all(line, '{entities.IMAGE}', 1)) as value from newlines),
plain as (select *, regexp_replace(regexp_replace(regexp_replace(relative_path, '[^/]*$', '') || regexp_replace(value, '[?#].*$', ''), '(^|/)[.]/', '{chr(92)}1', 'g'), '/+', '/', 'g') as p0 from images where not regexp_matches(lower(value), '^(https?:|data:)')),
up as (select *, {"".join(["regexp_replace("] * 3)}p0{"".join([f", '(^|/)[^/]*[^/.][^/]*/[.][.]/', '{chr(92)}1')"] * 3)} as target from plain)
select unit_id, relative_path as file_path, cast(line_no as integer) as line_start, value as quote, 'missing_local_image' as issue_type from up u where not exists (select 1 from paths p where p.unit_id = u.unit_id and p.relative_path = u.target)
""",
    "stem_similarity": f"""
with {BASE},
x as (select relative_path, {stems("text")} as own, {stems("substr(text, 1, length(text) // 2)")} as a, {stems("substr(text, length(text) // 2 + 1)")} as b from own_files)
select relative_path, md5(array_to_string(list_sort(own), ' ')) as stems_md5, cast(len(own) as bigint) as n_stems, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0.0) as jaccard from x
""",
    "fact_claims": f"""
with {BASE},
states as (
  select *, coalesce(last_value(case when regexp_matches(line, '(?i){rx(context.THEORY_SECTION.removeprefix("(?iuU)"))}') then false when regexp_matches(line, '(?i){rx(context.TASK_SECTION.removeprefix("(?iuU)"))}') then true end ignore nulls)
    over (partition by {FILE} order by line_no rows between unbounded preceding and current row), false) as in_task from all_lines where kind in ('readme', 'material', 'text')
),
parts as (select *, unnest(p) as part, generate_subscripts(p, 1) as n from (select *, string_split(regexp_replace(line, '([.!?]){SPACES}+', '{chr(92)}1' || chr(1), 'g'), chr(1)) as p from states where not (in_task and kind = 'readme'))),
claims as (select *, {stripped("part")} as sentence, {_CLAIM} as claim, case kind when 'readme' then 0 when 'material' then 1 else 2 end as rank from parts),
kept as (
  select *, {matched_key("claim")} as key from claims
  where sentence <> '' and sentence not like '#%' and not regexp_matches(sentence, '^\\s*\\|.+\\|\\s*$') and not {said("sentence", context.FEEDBACK)} and not regexp_matches(sentence, '{context.OPTION}')
    and not (regexp_matches(sentence, '{_INNER}') and {words(f"regexp_replace(sentence, '{_INNER}', '', 'g')")} <= 3) and not (regexp_matches(sentence, '{_POINTER}') and {words(f"regexp_replace(sentence, '{_POINTER}', '', 'g')")} <= 6)
    and not ({_ASKED}) and not {said("claim", context.LEADING)} and not {said("claim", context.SECOND_PERSON)} and (regexp_matches(claim, '{context.FACT_DATE}') or not ({" or ".join(said("claim", p) for p in context.LOCAL)}))
    and length(claim) between 35 and 520 and not regexp_matches(lower(claim), '^(https?://|!\\[|\\[)') and {words("claim")} >= 5
    and (regexp_matches(claim, '{context.FACT_DATE}') or {said("claim", context.FACT)} or {said("claim", context.TECHNOLOGIES.removeprefix("(?iuU)"))})
),
first_ones as (select *, row_number() over (partition by unit_id, key order by rank, relative_path, line_no, n) as again from kept),
x as (select *, row_number() over (partition by unit_id order by rank, relative_path, line_no, n) as k from first_ones where again = 1)
select unit_id, cast(k as integer) as k, claim, relative_path, cast(line_no as integer) as line_no from x where k <= 8
""",
}

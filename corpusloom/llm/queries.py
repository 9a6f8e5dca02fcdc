"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, crosstok, fingerprint, html_text, langid, mixing, near_dup, packing, repair, sigtree, suffix_dedup, token_count
from .common import table


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents"), "text", "size")).select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


#: A conversation that says the template's own marks.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(turns.unionByName(probe)).withColumn("read", chat.read_turns(F.col("formatted")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss")))
    return done.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(replace(replace({}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
OP6_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE_TEXT}' union all select -7, 1, 'assistant', '{PROBE_TEXT}'
), ordered as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(length({_ESCAPED.format('text')}) + 7
    + case when before is distinct from role then length(replace({_ESCAPED.format('role')}, ':', '\\c')) + 7 else 0 end) as bigint) as formatted_chars
from ordered group by conv_id
"""


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two tokenizers, aligned by bytes."""
    return crosstok.alignment(table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' components of 5-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return sigtree.jaccard_components(table(spark, sf_dir, "documents"), words=5, percent=80)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the checksums of their rows' keys, and their cheapest repair."""
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


# The repair as a walk over rows that keeps, of each state, the cheapest edits with the least audit.
OP13_SQL = """
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations
), summed as (
  select conv_id, turn, role, text, list_reduce(list_transform(string_split(k, ''), lambda c: cast(ascii(c) as ubigint)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end), cast(4294967295 as ubigint)) as crc from keyed
), dealt as (
  select *, xor(crc, 4294967295) % 20 as d from summed
), rows_left as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role, case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when d = 3 then [0, 1] else [0] end) as copy from dealt where d <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core from rows_left
), sorted as (
  select conv_id, turn, role, text, n, role[1] as i, lag(role[1]) over (partition by conv_id order by n) as before, case when core = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when right(core, 1) not in ('.', '!', '?') then 'truncated' end as fault from placed
), inserts(s, ins, cost, then_s, said) as (values
  (0, '', 0, 0, ''), (1, '', 0, 1, ''), (2, '', 0, 2, ''), (3, '', 0, 3, ''), (0, 'I', 2, 2, chr(10) || 'user:'), (1, 'I', 2, 2, chr(10) || 'user:'), (2, 'I', 2, 3, chr(10) || 'assistant:'), (3, 'I', 2, 2, chr(10) || 'user:'),
  (0, 'II', 4, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 4, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 'II', 4, 2, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 'II', 4, 3, chr(10) || 'user:' || chr(10) || 'assistant:')
), kept(i, s, then_s) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), turned(s, then_s, name) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), walk as (
  select distinct conv_id, cast(0 as bigint) as n, 0 as s, 0 as cost, '' as audit, '' as said from sorted
  union all
  select conv_id, n, s, cost, audit, said from (
    select *, row_number() over (partition by conv_id, s order by cost, audit) as best from (
      select w.conv_id, r.n, e.then_s as s, w.cost + x.cost + e.cost as cost, w.audit || x.ins || e.edit as audit, w.said || x.said || e.said as said
      from walk w join sorted r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1 join inserts x on x.s = w.s
      join lateral (
        select 'D' as edit, 3 as cost, x.then_s as then_s, '' as said
        union all select 'K', case when r.fault = 'truncated' then 1 else 0 end, k.then_s, chr(10) || r.role || ':' || r.text from kept k where k.i = r.i and k.s = x.then_s and coalesce(r.fault, '') not in ('blank', 'duplicate')
        union all select 'R', case when r.fault = 'truncated' then 3 else 2 end, t.then_s, chr(10) || t.name || ':' || r.text from turned t where t.s = x.then_s and coalesce(r.fault, '') not in ('blank', 'duplicate')
      ) e on true)) where best = 1
), ended as (
  select conv_id, cost, audit, said from (
    select w.conv_id, w.cost + x.cost as cost, w.audit || x.ins as audit, w.said || x.said as said, row_number() over (partition by w.conv_id order by w.cost + x.cost, w.audit || x.ins) as best
    from walk w join inserts x on x.s = w.s and x.then_s in (0, 3) join (select conv_id, max(n) as n from sorted group by 1) m on m.conv_id is not distinct from w.conv_id and m.n = w.n) where best = 1
), stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (n > 1 and before || i not in ('su', 'ua', 'au')) as illegal
  from sorted group by 1
)
select c.conv_id, coalesce(s.gaps, 0) as gaps, coalesce(s.blank, 0) as blank, coalesce(s.duplicate, 0) as duplicate, coalesce(s.truncated, 0) as truncated, coalesce(s.illegal, 0) as illegal,
  cast(coalesce(e.cost, 0) as bigint) as cost, coalesce(e.audit, '') as audit, sha256(coalesce(substr(e.said, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats s on s.conv_id is not distinct from c.conv_id left join ended e on e.conv_id is not distinct from c.conv_id
"""


QUERIES = {f.__name__: f for f in (op1_token_count, op2_mix_sources, op3_nearest_vectors, op4_best_fit_packing, op5_suffix_dedup, op6_chat_format, op7_fingerprint, op8_language_id, op9_near_duplicates, op10_main_text, op11_token_alignment, op12_jaccard_join, op13_structure_repair)}
#: The others need a tokenizer, a hash order or a model that SQL doesn't have; tests/llm holds them against brute force.
ORACLE_SQL = {"op6_chat_format": OP6_SQL, "op13_structure_repair": OP13_SQL}

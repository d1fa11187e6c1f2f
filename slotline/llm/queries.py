"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm import audio, chat_format, exact_dedup, html_content, langid, mixing, ngram_join, packing, pseudo_lm, quality_crf, resampling, url_filter, whitening
from slotline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_turns(rows))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.format_turns(table(spark, sf_dir, "conversations"))
    return packing.pack_instructions(turns, public_tokenizers.path("word_bpe_49k.json"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(audio.analyse(audio.store(table(spark, sf_dir, "documents"))))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_ids(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    return langid.fuse(langid.page_rows(table(spark, sf_dir, "pages")), model).withColumnRenamed("id", "page_id")


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score_own(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mark")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that a long can't hold is null here; the operator has it as a decimal."""
    out = whitening.whiten_rows(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_crf, op2_url_filter, op3_ngram_join, op4_chat_format, op5_packing, op5_instruction_packing, op6_exact_dedup, op7_audio_features,
    op8_language_id, op8_page_language, op9_pseudo_likelihood, op10_mixing, op11_importance_resampling, op12_embedding_whitening,
    op13_html_content,
)}

SQL = {
    "op2_url_filter": r"""
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r as (select *, case
  when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
  when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
  when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
  when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule,
  case when regexp_matches(host, '(^|\.)casino-[^/]*\.') then 'casino-*' when regexp_matches(host, '(^|\.)free-bets\.') then 'free-bets'
  when regexp_matches(host, '(^|\.)cheap-[^/]*\.') then 'cheap-*' when regexp_matches(host, '(^|\.)adult-[^/]*\.') then 'adult-*'
  when regexp_matches(host, '(^|\.)spam-[^/]*\.') then 'spam-*' when regexp_matches(host, '(^|\.)ads-[^/]*\.') then 'ads-*' end as own from p)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when own is not null then 'block' else 'allow' end as verdict, case when rule is null then own end as glob_rule from r""",
    "op3_ngram_join": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, list_distinct(case when len(words) = 0 then []::varchar[] when len(words) < 5 then [array_to_string(words, ' ')]
  else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as set from w),
g as (select doc_id, len(set) as n, unnest(set) as shingle from s),
p as (select a.doc_id as x, b.doc_id as y from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e as (select x, y from p union all select y, x from p),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select s.doc_id, len(s.set)::bigint as n_shingles, least(s.doc_id, coalesce(c.least_id, s.doc_id)) as component_id
from s left join (select x, min(y) as least_id from r group by x) c on c.x = s.doc_id""",
    "op4_chat_format": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select *, case role when 'user' then ' [/INST]' when 'system' then chr(10) || '<</SYS>>' || chr(10) || chr(10) when 'assistant' then '</s>' else '<|end|>' end as closing,
  case role when 'user' then 15 when 'system' then 19 when 'assistant' then 5 else 23 end as frame,
  case when role in ('user', 'system', 'assistant') then '' else role end as named from c),
e as (select *, contains(text, closing) or starts_with(text, '<|esc|>') or contains(named, '<|text|>') or starts_with(named, '<|esc|>') as escaped,
  length(regexp_replace(text, '[\\<\[]', 'xx', 'g')) + 7 as long_text, length(regexp_replace(named, '[\\<\[]', 'xx', 'g')) + 7 as long_role from f)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(frame + case when not escaped then length(text) + length(named) when named = '' and role in ('user', 'system', 'assistant') then long_text else long_text + long_role end)::bigint as formatted_chars
from e group by conv_id""",
    "op6_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d""",
    "op13_html_content": r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') as body from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), chr(1)) as parts from a),
d as (select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as parts from b),
t as (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) as text from d)
select page_id, url, text, length(text)::bigint as n_chars from t""",
}

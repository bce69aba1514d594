"""One query per operator over its whole table, with a DuckDB twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.llm import (
    bpe, chat, digests, merkle, near_text, near_vectors, negatives, packing, quality, shards, site_lines, toxicity, warc,
)
from quantframe.llm.registry import ORACLES, QUERIES, query
from quantframe.llm.sources import table
from quantframe.session import staged

__all__ = ["ORACLES", "QUERIES"]

GPT_JSON, GPT_RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), GPT_JSON, GPT_RANKS, public_tokenizers.PATTERN).drop("piece")


OP4_SQL = rf"""
with page as (
  select page_id, html,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
    regexp_replace(regexp_replace(regexp_replace(html, '{site_lines.HIDDEN}', '', 'g'), '{site_lines.BLOCK}', chr(10), 'g'),
      '{site_lines.TAG}', '', 'g') as text
  from pages),
line as (
  select page_id, host, text, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from page),
normal as (select *, lower(trim(regexp_replace(line, '{site_lines.GAPS}', ' ', 'g'), ' ')) as norm from line),
totals as (select host, count(distinct text) as pages from page where text is not null group by host),
common as (
  select host, norm from normal join totals using (host) where norm <> '' group by host, norm, pages
  having count(distinct text) >= 3 and count(distinct text) >= 0.1 * pages),
kept as (
  select page_id, count(*) as n_lines, count(c.norm) as n_dropped,
    string_agg(line, chr(10) order by pos) filter (where c.norm is null) as kept
  from normal n left join common c on n.host = c.host and n.norm = c.norm group by page_id)
select p.page_id, p.host, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped,
  case when p.text is not null then md5(coalesce(kept, '')) end as kept_md5
from page p left join kept k on p.page_id = k.page_id
"""


@query("op4_site_lines", OP4_SQL)
def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", site_lines.host_of(F.col("url")).alias("host"), site_lines.visible(F.col("html")).alias("text"))
    # the texts are read twice, and cutting the tags away is most of the work
    out = site_lines.drop_site_lines(staged(pages), "host", "text", boilerplate_ratio=0.1, min_pages=3)
    return out.select("page_id", "host", "n_lines", "n_dropped", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


@query("op5_ngram_jaccard")
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.jaccard_components(table(spark, sf_dir, "documents"), words=3, numerator=90, denominator=100)


OP6_SQL = """
with payload as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
digest as (
  select page_id, octet_length(encode(html)) as payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31) + 1)::int, 1) for i in range(32)], '') as payload_digest
  from payload),
firsts as (select payload_digest, min(page_id) as first_id from digest group by payload_digest)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from digest join firsts using (payload_digest)
"""


@query("op6_warc", OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(table(spark, sf_dir, "documents"))


@query("op9_shards")
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.write_and_read(table(spark, sf_dir, "documents"), GPT_JSON, GPT_RANKS, public_tokenizers.PATTERN)


@query("op10_quote_links")
def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.conversations(chat.link_quotes(table(spark, sf_dir, "conversations")))
    return linked.withColumn("clean_md5", F.md5(F.col("clean_text").cast("binary"))).drop("clean_text")


@query("op1_nn_descent")
def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.vector_links(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with recursive crc as (
  select list(v order by i) as t from (
    select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from (select unnest(range(256)) as i))),
doc as (
  select *, (row_number() over (partition by lang order by doc_id nulls first)) - 1 as pos, count(*) over (partition by lang) as size,
    n_chars is not null and coalesce(xor(list_reduce(list_concat([4294967295], [ord(c) for c in string_split(doc_id::varchar, '')]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) as tampered
  from documents, crc),
coded as (
  select *, [coalesce(strlen(x) || ':' || x, '-') for x in [doc_id::varchar, source, lang, n_chars::varchar, text]] as p,
    (n_chars + 1)::varchar as more
  from doc),
leaf as (
  select doc_id, lang, pos, size, tampered, sha256(array_to_string(p, '')) as leaf,
    sha256(p[1] || p[2] || p[3] || coalesce(strlen(more) || ':' || more, '-') || p[5]) as changed
  from coded),
tree as (
  select lang, 0 as level, pos, size, leaf as h from leaf
  union all
  select lang, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' order by pos)) from tree where size > 1
  group by lang, level, pos // 2, (size + 1) // 2),
subs as (select lang, h, (row_number() over (order by lang nulls first)) - 1 as pos, count(*) over () as size from tree where size = 1),
top as (
  select 0 as level, pos, size, h from subs
  union all
  select level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' order by pos)) from top where size > 1
  group by level, pos // 2, (size + 1) // 2),
walk as (
  select l.doc_id, l.lang, l.pos, l.size, 0 as level, false as upper, case when tampered then changed else leaf end as h, '' as proof, leaf, tampered from leaf l
  union all
  select w.doc_id, w.lang,
    case when w.size > 1 then w.pos // 2 when w.upper then w.pos else s.pos end,
    case when w.size > 1 then (w.size + 1) // 2 when w.upper then 1 else s.size end,
    case when w.size > 1 then w.level + 1 else 0 end,
    w.upper or w.size = 1,
    case when w.size = 1 then w.h when n.h is null then sha256(w.h) when w.pos % 2 = 0 then sha256(w.h || n.h) else sha256(n.h || w.h) end,
    w.proof || coalesce(case when w.size > 1 then n.h end, ''), w.leaf, w.tampered
  from walk w
  left join (select lang, level, pos, h, false as upper from tree union all select null, level, pos, h, true from top) n
    on n.upper = w.upper and (w.upper or n.lang is not distinct from w.lang) and n.level = w.level and n.pos = xor(w.pos, 1::bigint) and w.size > 1
  join subs s on s.lang is not distinct from w.lang
  where w.size > 1 or not w.upper)
select doc_id, leaf, s.h as subroot, (select h from top where size = 1) as root, sha256(proof) as proof_sha256, w.h as folded_root,
  w.h = (select h from top where size = 1) as verified
from walk w join subs s on s.lang is not distinct from w.lang where w.upper and w.size = 1
"""


@query("op11_merkle", OP11_SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents")).drop("witness")


OP12_SQL = """
with fine as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null and len(embedding) = len([x for x in embedding if x is not null and isfinite(x)])),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other, list_inner_product(a.v, b.v)::bigint as score
  from fine a join fine b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positive as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, other))::integer as rank,
  other as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.embedding_negatives(table(spark, sf_dir, "embeddings"))


@query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Queries over news texts, vectors and retrieval."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe import fixtures
from quantframe.functions import reports as rp
from quantframe.functions import text as tx
from quantframe.functions.vectors import cosine
from quantframe.operators import news as nw
from quantframe.operators import relevance as rl
from quantframe.operators import retrieval as rt
from quantframe.operators import tables as tb
from quantframe.plans.oracle_views import TICKER_SQL
from quantframe.plans.registry import query
from quantframe.session import shared_dir
from quantframe.sources import files

_TRIM_CHARS = tx.WHITESPACE

NEWS = f"""news AS (
 SELECT doc_id, text, source AS url, 1704067200.0::DOUBLE + (doc_id * 3600) % 2592000 AS published_at,
  {TICKER_SQL.format(n='doc_id')} AS ticker, doc_id % 17 = 0 AS no_ticker FROM documents)"""

VECTORS = f"""{NEWS},
vecs AS MATERIALIZED (
 SELECT CASE WHEN doc_id % 5 <> 0 THEN 'fin_news_v1' ELSE 'tenant_t' || (doc_id % 3) END AS namespace, doc_id AS id,
  embedding::DOUBLE[] AS embedding, label, text, 'news_api' AS source, url, published_at,
  CASE quality WHEN 1 THEN 'POSITIVE' WHEN 0 THEN 'NEGATIVE' END AS sentiment, quality * 0.5::DOUBLE + 0.25 AS sentiment_score,
  ticker AS ticker_principal
 FROM news JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings) LEFT JOIN labels USING (doc_id))"""

QUERIES = f"""{VECTORS},
means AS (
 SELECT label, list(m ORDER BY i) AS vector FROM (SELECT label, i, avg(e) AS m FROM (
  SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
 GROUP BY label),
asks AS MATERIALIZED (
 SELECT item_id::BIGINT AS query_id, vector, b.text AS query_text, 't' || (item_id % 3) AS tenant_id,
  {TICKER_SQL.format(n='item_id')} AS ticker FROM means JOIN benchmark b ON b.item_id % (SELECT count(*) FROM means) = label)"""


@query(
    "clean_articles",
    f"""WITH a AS (SELECT doc_id, CASE WHEN source = 'src6' THEN '[Removed]' ELSE ' ' || chr(10) || substr(text, 1, 60) END AS title,
 substr(text, 61) AS description, {TICKER_SQL.format(n='doc_id')} AS ticker FROM documents),
t AS (SELECT doc_id, trim(title, '{_TRIM_CHARS}') AS title, trim(coalesce(description, ''), '{_TRIM_CHARS}') AS description, ticker AS tickers FROM a)
SELECT * FROM t WHERE title <> '' AND title <> '[Removed]' AND description <> ''""",
)
def clean_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = nw.clean_articles(fixtures.articles(spark, sf_dir))
    return cleaned.select("doc_id", "title", "description", F.array_join("matched_tickers", ",").alias("tickers"))


@query(
    "news_text",
    "SELECT doc_id, 'TITLE: ' || substr(text, 1, 60) || '. DESCRIPTION: ' || substr(text, 61) || '. DATE: ' || '2024-01-'"
    " || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:30:15Z. URL: ' || source AS embedded_text FROM documents",
)
def news_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = fixtures.articles(spark, sf_dir).join(documents, "doc_id")
    title = F.substring("text", 1, 60)
    body = rp.news_text(title, F.col("description"), F.col("publishedAt"), F.col("url"))
    return joined.select("doc_id", body.alias("embedded_text"))


@query("epoch", "SELECT doc_id, 1704067200.0::DOUBLE + (doc_id % 28) * 86400 + 10 * 3600 + 30 * 60 + 15 AS published_at FROM documents")
def epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.articles(spark, sf_dir).select("doc_id", tx.epoch(F.col("publishedAt")).alias("published_at"))


@query(
    "validate_news",
    f"""WITH {NEWS} SELECT doc_id,
 CASE WHEN doc_id % 19 = 0 THEN 'malformed' WHEN trim(text, '{_TRIM_CHARS}') = '' THEN 'blank text' WHEN no_ticker THEN 'no tickers' END AS reason,
 CASE WHEN doc_id % 19 <> 0 THEN trim(text, '{_TRIM_CHARS}') END AS text FROM news""",
)
def validate_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.validate_news(fixtures.messages(spark, sf_dir)).select("doc_id", "reason", "text")


# words of the given texts next to the followed assets, so that matches of either kind occur
WORD_MAPPING = {"WORDS-1": "the OR and", "WORDS-2": "elle OR que", "WORDS-3": "der OR sch", "WORDS-4": "than OR there", "WORDS-5": "nicht OR une"}
MAPPING = {**tx.TICKER_QUERIES, **WORD_MAPPING}
#: Every term of the mapping once, and forms that must not match; one follows each text.
MENTIONS = [term for expression in tx.TICKER_QUERIES.values() for term in expression.split(" OR ")]
MENTIONS += ["xAPPLE", "S&P  500", "golden", "META_1", "alphabet!", "(btc)", "russell 2000", "Dow Jones-"]


def _mapping_sql() -> str:
    cases = []
    for ticker, expression in MAPPING.items():
        terms = "|".join(expression.split(" OR "))
        cases.append(
            f"CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({terms})([^\\p{{L}}\\p{{N}}_]|$)') THEN '{ticker}' END"
        )
    mentions = "[" + ", ".join(f"'{m}'" for m in MENTIONS) + "]"
    news = f"SELECT doc_id, text || ' ' || {mentions}[(doc_id % {len(MENTIONS)} + 1)::INTEGER] AS text FROM documents"
    return f"WITH n AS ({news}) SELECT doc_id, concat_ws(',', {', '.join(cases)}) AS tickers FROM n"


def _mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    mention = F.element_at(F.array(*[F.lit(m) for m in MENTIONS]), (F.pmod("doc_id", F.lit(len(MENTIONS))) + 1).cast("int"))
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" "), mention).alias("text"))


@query("class_mapping", _mapping_sql())
def class_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nw.match_phrases(_mentioning(spark, sf_dir), nw.phrase_table(spark, MAPPING))
    return found.select("doc_id", F.array_join("tickers", ",").alias("tickers"))


@query("transactional_flag", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{w}')" for w in tx.TRANSACTIONAL_KEYWORDS) + " AS bypass FROM conversations")
def transactional_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", tx.is_transactional(F.col("text")).alias("bypass"))


def _mask_sql(column: str) -> str:
    for kind, pattern in tx.PII_PATTERNS.items():
        column = f"regexp_replace({column}, '{pattern}', '[{kind}_REDACTED]', 'g')"
    return column


@query("mask_pii", f"SELECT doc_id, {_mask_sql('text')} AS masked, {_mask_sql('text')} <> text AS has_pii FROM documents")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixtures.table(spark, sf_dir, "documents")
    return documents.select("doc_id", tx.mask_pii(F.col("text")).alias("masked"), tx.has_pii(F.col("text")).alias("has_pii"))


@query("md5_key", f"WITH {NEWS} SELECT doc_id, substr(md5(text), 1, 8) AS doc_key, md5(text || '_0_' || CAST(published_at::BIGINT AS VARCHAR) || '.0') AS vector_id FROM news")
def md5_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.news(spark, sf_dir).select(
        "doc_id", files.doc_key(F.col("text")).alias("doc_key"),
        tx.vector_id(F.col("text"), F.lit(0), F.col("published_at")).alias("vector_id"),
    )


@query("conv_title", "SELECT conv_id, turn, substr(text, 1, 40) || '...' AS title FROM conversations")
def conv_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", tx.conv_title(F.col("text")).alias("title"))


LOGICAL_DAY = 1704672000.0  # 2024-01-08 UTC

_AGE_SQL = (
    "CASE WHEN greatest(0, round_even(({day} - published_at) / 86400, 0)) = 0 THEN 'TODAY'"
    " WHEN greatest(0, round_even(({day} - published_at) / 86400, 0)) = 1 THEN '1 DAY AGO'"
    " ELSE CAST(greatest(0, round_even(({day} - published_at) / 86400, 0))::BIGINT AS VARCHAR) || ' DAYS AGO' END"
).format(day=f"{LOGICAL_DAY}::DOUBLE")


@query("age_label", f"WITH {NEWS} SELECT doc_id, {_AGE_SQL} AS age FROM news")
def age_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = fixtures.news(spark, sf_dir)
    return news.select("doc_id", rp.age_label(F.lit(LOGICAL_DAY) - F.col("published_at")).alias("age"))


_LINE_SQL = f"'- ' || {_AGE_SQL} || ' | ' || text || ' | ' || coalesce(sentiment, 'NEUTRAL') || ' ' || printf('%.2f', coalesce(sentiment_score, 0.0))"


@query("news_line", f"WITH {VECTORS} SELECT id, {_LINE_SQL} AS line FROM vecs")
def news_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = rp.age_label(F.lit(LOGICAL_DAY) - F.col("published_at"))
    line = rp.news_line(
        age, F.col("text"), F.coalesce("sentiment", F.lit("NEUTRAL")), F.coalesce("sentiment_score", F.lit(0.0))
    )
    return fixtures.vectors(spark, sf_dir).select("id", line.alias("line"))


@query("pair_score", """WITH j AS (SELECT c.conv_id, c.turn, c.text, b.text AS query_text FROM conversations c JOIN benchmark b
 ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark)),
t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS a,
 list_distinct(list_filter(regexp_split_to_array(lower(query_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS q FROM j)
SELECT conv_id, turn, round(coalesce(len(list_intersect(q, a)) / nullif(len(q), 0)::DOUBLE, 0), 9) AS score FROM t""")
def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixtures.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query_text"))
    total = items.agg(F.count(F.lit(1))).scalar()
    rows = fixtures.table(spark, sf_dir, "conversations").withColumn("item_id", F.pmod("conv_id", total))
    score = tx.pair_score(F.col("query_text"), F.col("text"))
    return rows.join(items, "item_id").select("conv_id", "turn", F.round(score, 9).alias("score"))


_TERMS_SQL = "list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(
    "bm25",
    f"""WITH d AS (SELECT doc_id, {_TERMS_SQL.format(text="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d), t AS (SELECT term, doc_id, length, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS_SQL.format(text='text')})) AS term FROM benchmark),
r AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 9) AS score
 FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM r QUALIFY rank <= 10""",
)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item, over all documents."""
    items = fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return rl.bm25(items, fixtures.table(spark, sf_dir, "documents").select("doc_id", "text"), 10)


@query(
    "raw_archive",
    f"""WITH {NEWS}, keyed AS (SELECT *, md5(text) AS content_key, TIMESTAMP '1970-01-01' + to_seconds(published_at::BIGINT) AS seen FROM news)
SELECT 'raw/news/' || strftime(seen, '%Y/%m/%d') || '/doc_' || content_key || '.json' AS s3_key, arg_max(text, (seen, url)) AS text, max(seen) AS ingested_at, 'api_ingestion' AS source
FROM keyed GROUP BY strftime(seen, '%Y/%m/%d'), content_key""",
)
def raw_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.archive_rows(fixtures.news(spark, sf_dir).drop("doc_id"), tx.epoch_ntz(F.col("published_at")))
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    for _ in range(2):  # the second run adds nothing
        files.write_archive(rows, path)
    schema = "s3_key string, text string, ingested_at timestamp_ntz, source string"
    return spark.read.schema(schema).json(path).select("s3_key", "text", "ingested_at", "source")


_CUT = f"{LOGICAL_DAY}::DOUBLE - 5 * 86400"


@query(
    "retention_prune",
    f"WITH {VECTORS} SELECT namespace, id, published_at FROM vecs WHERE published_at >= {_CUT}",
)
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records lie by day, written twice; whole days before the cut go as folders, the day of the cut by its rows."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    stamp = tx.epoch_ntz(F.col("published_at"))
    records = fixtures.vectors(spark, sf_dir).select("namespace", "id", "published_at", F.date_format(stamp, "yyyy-MM-dd").alias("day"))
    for _ in range(2):
        files.write_days(records, path)
    first = dt.datetime.fromtimestamp(LOGICAL_DAY - 5 * tb.DAY_SECONDS, dt.UTC).strftime("%Y-%m-%d")
    files.drop_days(spark, path, first)
    kept = tb.retention_prune(spark.read.schema(records.schema).parquet(path), "published_at", F.lit(LOGICAL_DAY), days=5)
    return kept.select("namespace", "id", "published_at")


@query(
    "cache_prune",
    f"WITH {NEWS} SELECT md5(text) AS id, max(published_at) AS timestamp FROM news GROUP BY md5(text) HAVING max(published_at) >= {LOGICAL_DAY}::DOUBLE - 300",
)
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries lie by their day; expired days are dropped unread."""
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    newest = fixtures.news(spark, sf_dir).groupBy(F.md5("text").alias("id")).agg(F.max("published_at").alias("timestamp"))
    entries = newest.select("id", "timestamp", F.date_format(tx.epoch_ntz(F.col("timestamp")), "yyyy-MM-dd").alias("day"))
    for _ in range(2):
        files.write_days(entries, path)
    files.drop_days(spark, path, dt.datetime.fromtimestamp(LOGICAL_DAY - rt.CACHE_TTL, dt.UTC).strftime("%Y-%m-%d"))
    return spark.read.schema(entries.schema).parquet(path).where(F.col("timestamp") >= LOGICAL_DAY - rt.CACHE_TTL).drop("day")


@query(
    "vector_upsert",
    f"WITH {VECTORS} SELECT namespace, id, label + CASE WHEN label >= 5 THEN 100 ELSE 0 END AS label FROM vecs",
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fixtures.vectors(spark, sf_dir).select("namespace", "id", "label").withColumn("ingested", F.lit(1))
    again = first.filter(F.col("label") >= 5).withColumns({"label": F.col("label") + 100, "ingested": F.lit(2)})
    return tb.last_write_wins(first.unionByName(again), ["namespace", "id"], ["ingested"]).drop("ingested")


@query("namespace_stats", f"WITH {VECTORS} SELECT namespace, count(*) AS n_vectors FROM vecs GROUP BY namespace")
def namespace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.namespace_stats(fixtures.vectors(spark, sf_dir))


@query(
    "cosine",
    f"WITH {QUERIES} SELECT v.id, round(list_cosine_similarity(v.embedding, m.vector), 9) AS similarity FROM vecs v JOIN means m USING (label)",
)
def cosine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantframe.functions.vectors import centroids

    vectors = fixtures.vectors(spark, sf_dir).select("id", "label", "embedding")
    joined = vectors.join(centroids(fixtures.table(spark, sf_dir, "embeddings"), "label"), "label")
    return joined.select("id", F.round(cosine(F.col("embedding"), F.col("vector")), 9).alias("similarity"))


def _knn_sql(where: str, k: int, space: str = "v.namespace = 'fin_news_v1'") -> str:
    return f"""found AS MATERIALIZED (
 SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, a.ticker, tenant_id, query_text, v.namespace, v.id, v.text, published_at, sentiment, sentiment_score, ticker_principal, url, source,
   round(list_cosine_similarity(v.embedding, a.vector), 9) AS score FROM asks a JOIN vecs v ON {space} {where})
 QUALIFY rank <= {k})"""


@query("knn", f"WITH {QUERIES}, {_knn_sql('', 10)} SELECT query_id, namespace, id, score, rank FROM found")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fixtures.vector_queries(spark, sf_dir).withColumn("namespace", F.lit(rt.GLOBAL_NAMESPACE))
    return rt.knn(asked, fixtures.vectors(spark, sf_dir), 10)


_WINDOW = f"AND published_at BETWEEN {LOGICAL_DAY}::DOUBLE - 4 * 86400 AND {LOGICAL_DAY}::DOUBLE + 86400"


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fixtures.vector_queries(spark, sf_dir).withColumn("namespace", F.lit(rt.GLOBAL_NAMESPACE))
    return rt.knn_filtered(asked, fixtures.vectors(spark, sf_dir), LOGICAL_DAY)


@query(
    "knn_filtered",
    f"WITH {QUERIES}, {_knn_sql(_WINDOW, 15)} SELECT query_id, ticker, id, score, rank FROM found WHERE contains(ticker_principal, ticker)",
)
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir).select("query_id", "ticker", "id", "score", "rank")


@query(
    "news_context",
    f"""WITH {QUERIES}, {_knn_sql(_WINDOW, 15)},
hits AS (SELECT query_id, string_agg({_LINE_SQL}, chr(10) ORDER BY rank) AS lines FROM found WHERE contains(ticker_principal, ticker) GROUP BY query_id),
sig AS (SELECT query_id, 'Q' || query_id AS signal, CASE query_id % 3 WHEN 0 THEN 'HOT' WHEN 1 THEN 'GREY' ELSE 'COLD' END AS conviction_zone FROM asks)
SELECT signal, conviction_zone, CASE WHEN conviction_zone = 'COLD' THEN '{rp.COLD_NEWS}'
  ELSE coalesce(lines, '{rp.NO_NEWS}') END AS news_context,
 conviction_zone <> 'COLD' AND lines IS NOT NULL AS has_news FROM sig LEFT JOIN hits USING (query_id)""",
)
def news_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals are the queries, one per label; cold ones never reach the search."""
    zone = F.element_at(F.array(F.lit("HOT"), F.lit("GREY"), F.lit("COLD")), (F.pmod("query_id", F.lit(3)) + 1).cast("int"))
    asked = fixtures.vector_queries(spark, sf_dir).withColumns(
        {"namespace": F.lit(rt.GLOBAL_NAMESPACE), "conviction_zone": zone}
    )
    name = F.concat(F.lit("Q"), F.col("query_id"))
    warm = asked.filter(F.col("conviction_zone") != "COLD")
    matches = rt.knn_filtered(warm, fixtures.vectors(spark, sf_dir), LOGICAL_DAY).withColumn("ticker", name)
    signals = asked.select(name.alias("ticker"), "conviction_zone")
    return nw.news_context(signals, matches, LOGICAL_DAY).withColumnRenamed("ticker", "signal")


@query(
    "latest_feed",
    f"""WITH {VECTORS},
q AS (SELECT list(m ORDER BY i) AS vector FROM (SELECT i, avg(e) AS m FROM (SELECT unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)),
f AS (SELECT * FROM vecs, q WHERE namespace = 'fin_news_v1' ORDER BY round(list_cosine_similarity(embedding, vector), 9) DESC, id LIMIT 10)
SELECT id, coalesce(text, '') AS text, coalesce(sentiment, 'unknown') AS sentiment, coalesce(sentiment_score, 0.0) AS sentiment_score,
 coalesce(ticker_principal, 'none') AS ticker_principal, coalesce(ticker_principal, 'none') AS tickers_relacionados,
 coalesce(published_at, 0.0) AS published_at, source, url FROM f""",
)
def latest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantframe.functions.vectors import centroids

    everything = fixtures.table(spark, sf_dir, "embeddings").withColumn("query_id", F.lit(0).cast("long"))
    ask = centroids(everything, "query_id").withColumn("namespace", F.lit(rt.GLOBAL_NAMESPACE))
    return rt.latest_feed(ask, fixtures.vectors(spark, sf_dir))


_BOTH = "(v.namespace = 'fin_news_v1' OR v.namespace = 'tenant_' || tenant_id)"
_CANDIDATES_SQL = f"""{QUERIES}, {_knn_sql('', 10, _BOTH)},
cand AS (SELECT *, CASE WHEN namespace = 'fin_news_v1' THEN 0 ELSE 1 END AS source_order FROM found
 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY source_order, rank) = 1)"""


@query("union_distinct_by_id", f"WITH {_CANDIDATES_SQL} SELECT query_id, id, namespace, score, rank FROM cand")
def union_distinct_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rt.context_candidates(fixtures.vector_queries(spark, sf_dir), fixtures.vectors(spark, sf_dir))
    return found.select("query_id", "id", "namespace", "score", "rank")


@query(
    "rag_context",
    f"""WITH {_CANDIDATES_SQL},
tok AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS a,
 list_distinct(list_filter(regexp_split_to_array(lower(query_text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS q FROM cand),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(len(list_intersect(q, a)) / nullif(len(q), 0)::DOUBLE, 0) DESC, source_order, rank) AS place FROM tok QUALIFY place <= 4)
SELECT query_id, string_agg(text, chr(10) || '- ' ORDER BY place) AS context, count(*) AS n_sources FROM best GROUP BY query_id""",
)
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.rag_context(fixtures.vector_queries(spark, sf_dir), fixtures.vectors(spark, sf_dir))


def _prototypes(queries: DataFrame) -> DataFrame:
    """Label means as routing prototypes: the first half of the labels complex, the rest simple."""
    kind = F.when(F.col("query_id") < 5, "complex").otherwise("simple")
    return queries.select(kind.alias("namespace"), F.col("query_id").alias("id"), F.col("vector").alias("embedding"))


@query(
    "route_complexity",
    f"""WITH {QUERIES}, s AS (SELECT v.id, max(CASE WHEN query_id < 5 THEN round(list_cosine_similarity(v.embedding, a.vector), 9) END) AS c,
 max(CASE WHEN query_id >= 5 THEN round(list_cosine_similarity(v.embedding, a.vector), 9) END) AS s FROM vecs v, asks a GROUP BY v.id)
SELECT id AS query_id, c AS complex_score, s AS simple_score, CASE WHEN c > s THEN 'complex' ELSE 'simple' END AS complexity FROM s""",
)
def route_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fixtures.vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return rt.route_complexity(asked, _prototypes(fixtures.vector_queries(spark, sf_dir)))


def _cache(queries: DataFrame) -> DataFrame:
    return queries.select(
        F.lit(rt.CACHE_NAMESPACE).alias("namespace"), F.md5("query_text").alias("id"), F.col("vector").alias("embedding"),
        F.concat(F.lit("answer "), F.col("query_id")).alias("response"),
        (F.lit(fixtures.NEWS_EPOCH) + F.col("query_id") * 50).alias("timestamp"),
    )


_CACHE_SQL = f"""{QUERIES},
cache AS (SELECT md5(query_text) AS id, vector, 'answer ' || query_id AS response, 1704067200.0::DOUBLE + query_id * 50 AS timestamp FROM asks)"""

_KEYWORDS_SQL = " OR ".join(f"contains(lower(text), '{w}')" for w in tx.TRANSACTIONAL_KEYWORDS)


@query(
    "semantic_cache_lookup",
    f"""WITH {_CACHE_SQL},
flagged AS (SELECT id AS query_id, embedding, ({_KEYWORDS_SQL}) OR {_mask_sql('text')} <> text AS bypass FROM vecs),
near AS (SELECT query_id, response, timestamp, round(list_cosine_similarity(embedding, vector), 9) AS score FROM flagged, cache WHERE NOT bypass
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cache.id) = 1),
hits AS (SELECT query_id, CASE WHEN 1 - score < 0.15 AND 1704067550.0::DOUBLE - timestamp <= 300 THEN response END AS response FROM near)
SELECT query_id, bypass, response IS NOT NULL AS is_cached, response FROM flagged LEFT JOIN hits USING (query_id)""",
)
def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fixtures.vectors(spark, sf_dir).select(
        F.col("id").alias("query_id"), F.col("embedding").alias("vector"), F.col("text").alias("query_text")
    )
    cache = _cache(fixtures.vector_queries(spark, sf_dir))
    return rt.semantic_cache_lookup(asked, cache, F.lit(fixtures.NEWS_EPOCH + 350))


@query(
    "semantic_cache_save",
    f"""WITH {_CACHE_SQL},
entries AS (SELECT md5(text) AS id, 'new answer' AS response, max(published_at) AS timestamp FROM vecs GROUP BY md5(text)),
both_ AS (SELECT id, response, timestamp FROM cache UNION ALL SELECT * FROM entries)
SELECT id, arg_max(response, timestamp) AS response, max(timestamp) AS timestamp FROM both_ GROUP BY id""",
)
def semantic_cache_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = fixtures.vectors(spark, sf_dir).select(
        F.col("text").alias("query_text"), F.lit("new answer").alias("response"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.col("published_at").alias("timestamp"),
    )
    saved = rt.semantic_cache_save(_cache(fixtures.vector_queries(spark, sf_dir)), entries)
    return saved.select("id", "response", "timestamp")


@query(
    "chunk_fixed",
    f"WITH {NEWS}, s AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 500) / 450.0), 0)::BIGINT + 1)) AS i FROM news)"
    " SELECT doc_id, i::INTEGER AS chunk_no, substr(text, i * 450 + 1, 500) AS chunk FROM s",
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.chunk_documents(fixtures.news(spark, sf_dir).select("doc_id", "text"), "fixed")


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.chunk_documents(fixtures.news(spark, sf_dir).select("doc_id", "text"), "recursive")

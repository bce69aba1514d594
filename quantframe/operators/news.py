"""News documents: cleaning, validation, chunking, enrichment and context lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.reports import COLD_NEWS, NO_NEWS, age_label, news_line
from quantframe.functions.text import REMOVED, fixed_chunks, recursive_chunks, strip, vector_id
from quantframe.schemas import NEWS

CORRUPT = "_corrupt_record"


def clean_articles(articles: DataFrame) -> DataFrame:
    """Trimmed articles with title and description, removed ones dropped, ticker as an array."""
    blank = F.lit("")
    return (
        articles.withColumns(
            {
                "title": strip(F.coalesce("title", blank)),
                "description": strip(F.coalesce("description", blank)),
                "matched_tickers": F.array("ticker"),
            }
        )
        .filter((F.col("title") != "") & (F.col("title") != REMOVED) & (F.col("description") != ""))
        .drop("ticker")
    )


def validate_news(messages: DataFrame, body: str = "body") -> DataFrame:
    """Parse JSON messages and give each its verdict.

    Adds the parsed fields and ``reason``: null for a valid message, else why it goes to the
    dead-letter table.
    """
    schema = T.StructType([*NEWS.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = messages.withColumn("_n", F.from_json(body, schema, {"columnNameOfCorruptRecord": CORRUPT}))
    item = parsed.withColumns(
        {
            "text": strip(F.col("_n.text")),
            "published_at": F.col("_n.published_at"),
            "url": F.col("_n.url"),
            "tickers": F.col("_n.tickers"),
            "_bad": F.col(f"_n.{CORRUPT}").isNotNull() | F.col("_n").isNull(),
        }
    )
    reason = (
        F.when(F.col("_bad"), "malformed")
        .when(F.col("text").isNull() | F.col("published_at").isNull() | F.col("url").isNull(), "missing field")
        .when(F.col("text") == "", "blank text")
        .when(F.coalesce(F.size("tickers"), F.lit(0)) <= 0, "no tickers")
    )
    return item.withColumn("reason", reason).drop("_n", "_bad")


def valid_news(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull()).drop("reason")


def dead_letters(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull())


def chunk_documents(documents: DataFrame, mode: str = "recursive", text: str = "text") -> DataFrame:
    """One row per chunk with its position ``chunk_no``; ``mode`` is recursive or fixed."""
    cut = {"recursive": recursive_chunks, "fixed": fixed_chunks}[mode]
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.posexplode(cut(F.col(text))).alias("chunk_no", "chunk"))


def to_vectors(chunks: DataFrame, namespace: str = "fin_news_v1") -> DataFrame:
    """Vector records of embedded, scored chunks."""
    return chunks.select(
        F.lit(namespace).alias("namespace"),
        vector_id(F.col("chunk"), F.col("chunk_no"), F.col("published_at")).alias("id"),
        "embedding",
        F.col("chunk").alias("text"),
        F.lit("news_api").alias("source"),
        "url",
        "published_at",
        "sentiment",
        "sentiment_score",
        F.element_at("tickers", 1).alias("ticker_principal"),
        F.concat_ws(",", "tickers").alias("tickers_relacionados"),
    )


def news_context(signals: DataFrame, matches: DataFrame, day_epoch: float) -> DataFrame:
    """Context text and ``has_news`` per signal; at most the retrieval's top k lines each."""
    stamp = F.coalesce("published_at", F.lit(day_epoch))
    line = news_line(
        age_label(F.lit(day_epoch) - stamp),
        F.coalesce("text", F.lit("")),
        F.coalesce("sentiment", F.lit("NEUTRAL")),
        F.coalesce("sentiment_score", F.lit(0.0)),
    )
    lines = matches.select("ticker", F.struct(F.col("rank"), line.alias("line")).alias("_l"))
    joined = lines.groupBy("ticker").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("_l")), lambda x: x["line"]), "\n").alias("_text")
    )
    cold = F.col("conviction_zone") == "COLD"
    return (
        signals.join(joined, "ticker", "left")
        .withColumns(
            {
                "news_context": F.when(cold, COLD_NEWS).otherwise(F.coalesce("_text", F.lit(NO_NEWS))),
                "has_news": ~cold & F.col("_text").isNotNull(),
            }
        )
        .drop("_text")
    )


#: A dictionary of phrases travels to the texts up to this size.
DICTIONARY_ROWS, DICTIONARY_BYTES = 1 << 20, 8 << 20
WORD, GAP = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]"


def phrase_table(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """``ticker, place, phrase, words``: the alternatives of each search expression, in mapping order."""
    rows = [(t, i, p.lower()) for i, (t, expression) in enumerate(mapping.items()) for p in expression.split(" OR ")]
    frame = spark.createDataFrame(rows, "ticker string, place int, phrase string")
    return frame.withColumn("words", F.regexp_count("phrase", F.lit(WORD)))


def match_phrases(documents: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tickers``: the tickers of the phrases that occur in the text as whole words, in the order of ``place``.

    ``phrases`` as ``phrase_table`` gives them, each beginning and ending with a word.  A text is cut into words with
    the gaps behind them; runs of as many words as phrases have, exactly as they stand in the text but for
    case, meet the phrases by equality, so the cost does not grow with the number of phrases.  A dictionary that is
    counted to be small travels; a larger one is joined by the phrase.  Every row of ``documents`` stays; ``key`` is unique.
    """
    lengths = sorted(r[0] for r in phrases.select("words").distinct().collect())  # a few numbers
    rows, size = phrases.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    pieces = F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{GAP}*"), F.lit(0))

    def runs(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        run = lambda i: F.array_join(F.slice("_w", i, n), "")
        return F.transform(starts, lambda i: F.regexp_replace(run(i), F.lit(f"{GAP}+$"), F.lit("")))

    grams = F.array_distinct(F.flatten(F.array(*[runs(n) for n in lengths]))) if lengths else F.array().cast("array<string>")
    spread = documents.select(key, pieces.alias("_w")).select(key, F.explode(grams).alias("phrase"))
    small = rows <= DICTIONARY_ROWS and size <= DICTIONARY_BYTES
    met = spread.join(F.broadcast(phrases) if small else phrases, "phrase")
    found = met.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("place", "ticker"))).alias("_f"))
    found = found.select(key, F.transform("_f", lambda f: f["ticker"]).alias("tickers"))
    none = F.array().cast("array<string>")
    return documents.select(key).join(found, key, "left").withColumn("tickers", F.coalesce("tickers", none))


def default_sentiment(label: Column, score: Column) -> dict[str, Column]:
    """Upper-cased label and score; a failed scorer leaves UNKNOWN and 0."""
    return {
        "sentiment": F.coalesce(F.upper(label), F.lit("UNKNOWN")),
        "sentiment_score": F.when(label.isNull(), F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0))),
    }

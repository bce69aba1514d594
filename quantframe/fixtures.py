"""Derived views over the given tables: what each application table would hold.

Every view is a lazy plan over the full tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.operators.timeline import id_bucket, with_ordinal
from quantframe.session import passing, staged

TICKERS = ["SPY", "QQQ", "DIA", "GLD", "TLT", "IWM", "VIX"]
FIRST_DATE = "1995-01-01"
NEWS_EPOCH = 1704067200.0  # 2024-01-01 UTC
NEWS_SPAN = 2592000  # 30 days in seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_ticker(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TICKERS]), (F.pmod(number, F.lit(7)) + 1).cast("int"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades: ticker, price, quantity and the unique five-column order."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .withColumn("ticker", base_ticker(F.col("c_nationkey")))
        .drop("o_orderkey", "o_custkey", "c_custkey", "c_nationkey")
    )


TRADE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades numbered per ticker; staged, as numbering reads them twice and the joins should run once."""
    source = staged(trades(spark, sf_dir))
    buckets = [F.unix_date(F.to_date("l_shipdate")), id_bucket("l_orderkey")]
    return with_ordinal(source, ["ticker"], TRADE_ORDER, buckets, "rn").select("ticker", "rn", "price", "qty")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-tick bars on consecutive dates, with a one-tick bar where the last tick is odd; ``bar_no`` is the 1-based position in the ticker.

    Written to the shared folder, as the reading side takes several column subsets of it; the trades go then.
    """
    with passing(spark) as keep:
        numbered = ticks(spark, sf_dir).withColumn("bar_no", F.floor((F.col("rn") + 1) / 2).cast("long"))
        return keep(
            numbered.groupBy("ticker", "bar_no")
            .agg(
                F.min_by("price", "rn").alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", "rn").alias("close"),
                F.sum("qty").alias("volume"),
            )
            .withColumn("date", F.date_add(F.lit(FIRST_DATE).cast("date"), (F.col("bar_no") - 1).cast("int")))
        )


RETURN_SCALE = 100.0  # prices mix different parts, so log returns are scaled to daily size


def signals(spark: SparkSession, sf_dir: str, given: DataFrame | None = None) -> DataFrame:
    """Scored rows: bar, scaled returns, class probabilities from volume and range, thresholded class.

    ``given``: the bars, where the caller has built them already.
    """
    from quantframe.functions.signals import decide
    from quantframe.operators.features import compute, number_bars

    panel = number_bars(bars(spark, sf_dir) if given is None else given).filter(F.col("ticker") != "VIX")
    scored = compute(panel, ["log_returns", "forward_return"])
    p_buy = F.col("volume") / F.lit(125.0)
    p_sell = (F.lit(1.0) - p_buy) * F.col("low") / F.col("high")
    return scored.select(
        "ticker", "date", "bar_no", "close", "volume",
        (F.col("ret_1d") / RETURN_SCALE).alias("ret_1d"),
        (F.col("fwd_log_return") / RETURN_SCALE).alias("fwd_log_return"),
        p_buy.alias("prob_buy"), p_sell.alias("prob_sell"),
    ).withColumn("y_pred", decide(F.col("prob_buy"), F.col("prob_sell"), BUY_AT, SELL_AT))


# Production decision thresholds and label limits.
BUY_AT, SELL_AT = 0.4418490104448511, 0.5264213424699449
BULL_LIMIT, BEAR_LIMIT = 0.0053093753051493085, -0.005749496635898443
Q_HIGH_ORIGINAL, Q_LOW_ORIGINAL = 0.693799087600558, 0.25020639959880264


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with a known next return, labelled by the quantiles of that return."""
    from quantframe.operators.labels import label_by_quantiles, quantile_thresholds

    known = staged(signals(spark, sf_dir).filter(F.col("fwd_log_return").isNotNull()))
    return label_by_quantiles(known, quantile_thresholds(known), name="y_true")


def predictions(spark: SparkSession, sf_dir: str, given: DataFrame | None = None) -> DataFrame:
    """One pending prediction per scored bar; ``given`` as in ``signals``."""
    from quantframe.functions.signals import conviction

    scored = signals(spark, sf_dir, given)
    zones = conviction(F.col("prob_buy"), F.col("prob_sell"), BUY_AT, SELL_AT)
    return scored.select(
        F.concat(F.col("ticker"), F.lit("#"), F.lpad(F.col("bar_no").cast("string"), 9, "0")).alias("id"),
        F.date_add("date", 1).alias("prediction_date"),
        F.col("date").alias("signal_date"),
        "ticker",
        zones["ml_decision"].alias("quant_decision"),
        zones["probability"].alias("quant_probability"),
        zones["conviction_zone"].alias("conviction_zone"),
        F.lit("volume,range").alias("top_drivers"),
        F.col("close").alias("pred_close_price"),
        zones["leaning_action"].alias("llm_verdict"),
        F.lit(None).cast("double").alias("actual_close_price"),
        F.lit(None).cast("double").alias("realized_return"),
        F.lit("PENDING").alias("reconciliation_status"),
    )


def verdict_answers(scored: DataFrame) -> DataFrame:
    """External answers and the news flag of each of the scored rows, by volume."""
    v = F.col("volume")
    return scored.select(
        "ticker", "date", (v > 60).alias("has_news"),
        F.when(v > 95, F.lit(None)).when(v > 80, " buy now ").when(v > 70, "Sell.").when(v > 40, "hold")
        .otherwise("unsure").alias("answer"),
    )


def price_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price ticks; windows work on the zone-less timestamp as it is."""
    return table(spark, sf_dir, "events").select(
        base_ticker(F.col("user_id")).alias("ticker"), "ts", F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.lit(1.0).alias("qty"),
    )


def _published_at(number: Column) -> Column:
    return F.lit(NEWS_EPOCH) + F.pmod(number * 3600, F.lit(NEWS_SPAN))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items; some have no ticker."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("url"), _published_at(n).alias("published_at"),
        F.when(F.pmod(n, F.lit(17)) == 0, F.array().cast("array<string>"))
        .otherwise(F.array(base_ticker(n))).alias("tickers"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items as JSON messages; some are cut short."""
    body = F.to_json(F.struct("text", "published_at", "url", "tickers"))
    cut = F.substring(body, F.lit(2), F.length(body))
    return news(spark, sf_dir).select(
        "doc_id", F.when(F.pmod(F.col("doc_id"), F.lit(19)) == 0, cut).otherwise(body).alias("body")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw articles: the first words are the title, the rest the description."""
    n = F.col("doc_id")
    removed = F.col("source") == "src6"
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(removed, "[Removed]").otherwise(F.concat(F.lit(" \n"), F.substring("text", 1, 60))).alias("title"),
        F.substring(F.col("text"), F.lit(61), F.length("text")).alias("description"),
        F.col("source").alias("url"),
        F.concat(F.lit("2024-01-"), F.lpad((F.pmod(n, F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("T10:30:15Z"))
        .alias("publishedAt"),
        base_ticker(n).alias("ticker"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a vector record: the embeddings take turns, metadata comes from documents and labels."""
    documents = news(spark, sf_dir).select("doc_id", "text", "url", "published_at")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    total = given.agg(F.count(F.lit(1))).scalar()
    n = F.col("doc_id")
    space = F.when(F.pmod(n, F.lit(5)) != 0, "fin_news_v1").otherwise(F.concat(F.lit("tenant_t"), F.pmod(n, F.lit(3))))
    own = documents.withColumn("vec_id", F.pmod(n, total)).join(given, "vec_id")
    return own.join(marks, "doc_id", "left").select(
        space.alias("namespace"), n.alias("id"), "embedding", "label", "text", F.lit("news_api").alias("source"), "url", "published_at",
        F.when(F.col("quality") == 1, "POSITIVE").when(F.col("quality") == 0, "NEGATIVE").alias("sentiment"),
        (F.col("quality") * 0.5 + 0.25).alias("sentiment_score"),
        base_ticker(n).alias("ticker_principal"), base_ticker(n).alias("tickers_relacionados"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark item: its text, the mean vector of a label in turn, a tenant and a ticker."""
    from quantframe.functions.vectors import centroids

    means = centroids(table(spark, sf_dir, "embeddings"), "label")
    total = table(spark, sf_dir, "embeddings").select("label").distinct().agg(F.count(F.lit(1))).scalar()
    item = F.col("item_id")
    texts = table(spark, sf_dir, "benchmark").select(item, F.col("text").alias("query_text"), F.pmod(item, total).cast("int").alias("label"))
    return texts.join(means, "label").select(
        item.cast("long").alias("query_id"), "vector", "query_text",
        F.concat(F.lit("t"), F.pmod(item, F.lit(3))).alias("tenant_id"), base_ticker(item).alias("ticker"),
    )


def alert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as alert requests; some break a rule."""
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        n.alias("alert_id"), F.concat(F.lit("t"), F.pmod("c_nationkey", F.lit(3))).alias("tenant_id"),
        n.cast("string").alias("user_id"),
        F.when(F.pmod(n, F.lit(29)) == 0, "").otherwise(F.lower(base_ticker(F.col("c_nationkey")))).alias("ticker"),
        (F.col("c_acctbal") / 20).alias("target_price"),
        F.when(F.pmod(n, F.lit(23)) == 0, "equal").when(F.pmod(n, F.lit(2)) == 0, "above").otherwise("below")
        .alias("condition"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored alerts."""
    n = F.col("c_custkey")
    state = F.element_at(F.array(F.lit("active"), F.lit("triggered"), F.lit("cancelled")), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        n.alias("alert_id"), F.concat(F.lit("t"), F.pmod("c_nationkey", F.lit(3))).alias("tenant_id"),
        n.cast("string").alias("user_id"), base_ticker(F.col("c_nationkey")).alias("ticker"),
        (F.abs("c_acctbal") / 20).alias("target_price"),
        F.when(F.pmod(n, F.lit(2)) == 0, "above").otherwise("below").alias("condition"), state.alias("status"),
    )


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log; every seventh event comes from a stranger."""
    ops = F.create_map(*[F.lit(x) for x in ("signup", "create", "click", "update", "purchase", "trigger", "error", "cancel")])
    return table(spark, sf_dir, "events").filter(F.col("event_type") != "view").select(
        F.col("user_id").alias("alert_id"), F.col("event_id").alias("seq"), ops[F.col("event_type")].alias("op"),
        F.col("value").alias("target_price"), F.lit("t0").alias("tenant_id"),
        F.when((F.col("event_type") != "signup") & (F.pmod("event_id", F.lit(7)) == 0), "stranger")
        .otherwise(F.col("user_id").cast("string")).alias("user_id"),
    )


# Models of the answers; the last two are not priced.
ANSWER_MODELS = [
    "gemini-3.5-flash", "gemini-3.1-pro-preview", "gemini-2.5-pro", "gemini-2.5-flash", "gemini-3.1-flash-lite",
    "local-model", "failed_all",
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as charged answers of three users."""
    models = F.array(*[F.lit(m) for m in ANSWER_MODELS])
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.concat(F.lit("u"), F.pmod("conv_id", F.lit(3))).alias("user_id"), "conv_id", "turn",
        F.element_at(models, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) + 1).cast("int")).alias("model"),
        (F.pmod(F.col("conv_id") * F.col("turn"), F.lit(5)) == 3).alias("is_cached"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as recorded tool calls; expected is a name or a JSON list of names."""
    from quantframe.sources.files import as_tool_array

    n = F.col("conv_id") + F.col("turn")
    tools = ["set_price_alert", "get_user_alerts", "execute_paper_trade", "none"]
    called = F.array(*[F.lit(t) for t in tools])
    expected = F.when(F.pmod(n, F.lit(3)) == 0, '["set_price_alert", "get_user_alerts"]').when(
        F.pmod(n, F.lit(3)) == 1, "execute_paper_trade").otherwise("none")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", as_tool_array(expected).alias("expected_tool"),
        F.when(F.pmod(n, F.lit(13)) == 0, "API_ERROR")
        .otherwise(F.element_at(called, (F.pmod(n, F.lit(4)) + 1).cast("int"))).alias("called_tool"),
    )


def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with judge scores; some judgements failed."""
    failed = F.pmod("conv_id", F.lit(11)) == 0
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", "turn",
        F.when(~failed, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) / 4.0).alias("faithfulness"),
        F.when(~failed, F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(9)) / 8.0).alias("relevance"),
    )


def rate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests; views carry no authorization."""
    from quantframe.operators.chat import rate_key

    auth = F.when(F.col("event_type") != "view", F.concat(F.lit("user-"), F.col("user_id")))
    address = F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(250)))
    return table(spark, sf_dir, "events").select(rate_key(auth, address).alias("caller"), "ts", "event_id")

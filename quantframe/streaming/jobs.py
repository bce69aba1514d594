"""Structured Streaming jobs.  Each reuses a batch operator; sinks are keyed by batch id, so a
replayed micro-batch overwrites its own output instead of adding to it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from quantframe.functions.reports import alert_message
from quantframe.operators.bars import tick_bars
from quantframe.operators.chat import START_CREDITS, credit_ledger, rate_flags
from quantframe.operators.news import chunk_documents, dead_letters, to_vectors, valid_news, validate_news
from quantframe.sources.files import content_key, doc_key
from quantframe.sources.merged import MergedTable

# Delay and number of repeated attempts.
RETRY_SECONDS, MAX_RETRIES = 10, 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def queue_source(
    spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None, files_per_batch: int = 64
) -> DataFrame:
    """Messages as a stream with a ``body`` column: JSON-lines files, or a Kafka topic by options."""
    if kafka is not None:
        stream = spark.readStream.format("kafka").options(**kafka).load()
        return stream.select(F.col("value").cast("string").alias("body"))
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "body")


def drain(writer) -> None:
    """Run a stream over everything available now, raising its error if it fails."""
    query: StreamingQuery = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def before_closing(stream: DataFrame, closing: dt.datetime | None, ts: str = "ts") -> DataFrame:
    """Drop the closing rows of a finite stream, after its watermark has seen them.

    A finite stream ends with a row at ``closing``, later than every window: it moves the watermark past the last one, so
    that all of them leave the stream.  The comparison is on the time column itself, which keeps the row in the plan until
    the watermark has been taken.
    """
    return stream if closing is None else stream.where(F.col(ts) < F.lit(closing))


def stream_validate_dlq(messages: DataFrame, valid_path: str, dead_path: str, checkpoint: str):
    """Route valid messages and dead letters to two tables."""

    def route(batch: DataFrame, batch_id: int) -> None:
        checked = validate_news(batch).persist()
        valid_news(checked).write.mode("overwrite").parquet(_batch_path(valid_path, batch_id))
        dead_letters(checked).write.mode("overwrite").parquet(_batch_path(dead_path, batch_id))
        checked.unpersist()

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(route)


class _Retry(StatefulProcessor):
    """A failed message waits on a timer; each attempt is made once, when its timer expires."""

    def __init__(self, attempt: Callable[[pd.Series, int], pd.Series], delay_ms: int, most: int):
        self.attempt, self.delay, self.most = attempt, delay_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "body string, tries int, copies long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        copies, body, at = 0, None, 0  # a clock row has no body
        for part in rows:
            copies, body = copies + len(part), part["body"].iloc[0]
            at = max(at, int(part["at"].max().timestamp() * 1000))
        if body is not None:
            if self.waiting.exists():  # the same message again: it shares the attempts that are under way
                _, tries, before = self.waiting.get()
                self.waiting.update((body, tries, before + copies))
            else:
                self.waiting.update((body, 0, copies))
                self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs()) + self.delay)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        body, tries, copies = self.waiting.get()
        tries += 1
        if bool(self.attempt(pd.Series([body]), tries).iloc[0]):
            outcome = "done"
        elif tries < self.most:
            outcome = "again"
            self.waiting.update((body, tries, copies))
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.delay)
        else:
            outcome = "dead"
        if outcome != "again":
            self.waiting.clear()
        yield pd.DataFrame({"body": [body] * copies, "retry_count": [tries] * copies, "outcome": [outcome] * copies})

    def close(self) -> None:
        pass


def stream_retry(
    messages: DataFrame,
    failed: Column,
    attempt: Callable[[pd.Series, int], pd.Series],
    delay_seconds: int = RETRY_SECONDS,
    retries: int = MAX_RETRIES,
    lateness: str = "1 second",
) -> DataFrame:
    """Process messages ``(body, at)``; the result has a row ``(body, retry_count, outcome)`` per attempt.

    ``failed`` is the first attempt, taken in the plan: what succeeds never reaches the state.  A message that fails
    waits in keyed state on a timer of ``delay_seconds`` and is attempted again by ``attempt(bodies, tries)``, true where it
    succeeds, up to ``retries`` times; then it is dead.  Time is the watermark of ``at``, the message's arrival, so a
    stream without new messages needs a clock row (a null body) now and then; arrivals that go back by more than
    ``lateness`` are late and lost.  Equal messages of one input partition share a timer.
    Outcomes: done, again (a failed attempt that is not the last), dead.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers need it
    spoiled = F.coalesce(failed, F.lit(True))
    first = messages.where(F.col("body").isNotNull()).select(
        "body", F.lit(0).alias("retry_count"), F.when(spoiled, "again").otherwise("done").alias("outcome")
    )
    # clock rows pass the watermark with the failed messages and end in a state of their own, without timers
    waiting = messages.where(F.col("body").isNull() | spoiled).withWatermark("at", lateness)
    keyed = waiting.select("body", "at", F.md5("body").alias("key"), F.spark_partition_id().alias("part"))
    retried = keyed.groupBy("key", "part").transformWithStateInPandas(
        _Retry(attempt, delay_seconds * 1000, retries), "body string, retry_count int, outcome string", "append", "eventtime"
    )
    return first.unionByName(retried)


def enrich(
    news: DataFrame, score: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], mode: str = "recursive"
) -> DataFrame:
    """Valid news to vector records: sentiment once on the whole text, then chunks, then vectors."""
    chunks = chunk_documents(score(news), mode)
    return to_vectors(embed(chunks))


def vector_table(path: str) -> MergedTable:
    """The vector records of a stream of batches, by namespace and id."""
    return MergedTable(path, ("namespace", "id"), VECTOR_SCHEMA)


VECTOR_SCHEMA = (
    "namespace string, id string, embedding array<float>, text string, source string, url string, published_at double,"
    " sentiment string, sentiment_score double, ticker_principal string, tickers_relacionados string"
)
#: Batches after which they are merged into the base.
MERGE_EVERY = 8


def stream_enrich(
    messages: DataFrame,
    vector_path: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
    embed: Callable[[DataFrame], DataFrame],
    merge_every: int = MERGE_EVERY,
    mode: str = "recursive",
):
    """Validate, score, chunk, embed and store; ids are content hashes, so repeats collapse on read.

    Every ``merge_every`` batches the open ones are merged into the base, bucket by bucket.
    """
    vectors = vector_table(vector_path)

    def store(batch: DataFrame, batch_id: int) -> None:
        vectors.append(enrich(valid_news(validate_news(batch)), score, embed, mode), batch_id)
        if (batch_id + 1) % merge_every == 0:
            vectors.merge(batch.sparkSession)

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)


def read_vectors(spark: SparkSession, vector_path: str) -> DataFrame:
    """Current vector table: the base and, over it, the records of the batches since."""
    return vector_table(vector_path).read(spark)


RECORD_SCHEMA = "ticker string, condition string, ts long, seq long, price double, beyond double"
#: Copies of the records that meet the alerts of a ticker, each with another share of them.
ALERT_SHARES = 32


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New highs and new lows of each ticker, by position, among the ticks of a task.

    ``beyond`` is the previous high (low): a target is first met by the one record whose price reaches it from there.
    """
    held: dict[str, pd.DataFrame] = {}  # the records so far, never more than the ticks that set one
    for batch in batches:
        for ticker, ticks in batch.to_pandas().groupby("ticker", sort=False):
            if ticker in held:
                ticks = pd.concat([held[ticker], ticks])
            ticks = ticks.sort_values(["ts", "seq"], kind="stable")
            price = ticks["price"].to_numpy()
            above = np.concatenate([[-np.inf], np.maximum.accumulate(price)[:-1]])
            below = np.concatenate([[np.inf], np.minimum.accumulate(price)[:-1]])
            held[ticker] = ticks[(price > above) | (price < below)]
    for ticks in held.values():
        price = ticks["price"].to_numpy()
        for condition, best, worst, new in (("above", np.maximum, -np.inf, np.greater), ("below", np.minimum, np.inf, np.less)):
            beyond = np.concatenate([[worst], best.accumulate(price)[:-1]])
            some = ticks.assign(condition=condition, beyond=beyond)[new(price, beyond)]
            yield pa.RecordBatch.from_pandas(some[["ticker", "condition", "ts", "seq", "price", "beyond"]], preserve_index=False)


def _once(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first crossing of an alert that has not fired."""
    if state.exists:
        return
    first = None
    for part in chunks:
        best = part.sort_values(["ts", "seq"]).iloc[:1]
        if first is None or (best["ts"].iloc[0], best["seq"].iloc[0]) < (first["ts"].iloc[0], first["seq"].iloc[0]):
            first = best
    state.update((int(first["seq"].iloc[0]),))
    yield first


def stream_alerts(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """``alert_id, ticker, condition, target_price, price, ts, seq, message`` of every alert that fires, once.

    An active alert fires at the first tick ``(ticker, ts, seq, price)`` whose price meets its condition, by position inside
    a micro-batch and by arrival over batches, whether or not the price has come back since.  Tasks reduce
    their ticks to new highs and lows, each of which can be the first crossing of the targets between it and the one
    before only; what is left meets the alerts, and the keyed state of an alert lets it fire once.  Prices that are null or 0
    count for nothing.  ``alerts`` is read anew for each micro-batch.
    """
    known = ticks.where(F.col("price").isNotNull() & (F.col("price") != 0)).select(
        "ticker", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("seq").cast("long").alias("seq"), "price"
    )
    records = known.mapInArrow(_records, RECORD_SCHEMA)
    shares = F.sequence(F.lit(0).cast("long"), F.lit(ALERT_SHARES - 1).cast("long"))
    records = records.withColumn("share", F.explode(shares))
    active = alerts.where(F.col("status") == "active").select("alert_id", "ticker", "condition", "target_price")
    active = active.withColumn("share", F.pmod(F.xxhash64("alert_id"), F.lit(ALERT_SHARES)))
    target, price, beyond = F.col("target_price"), F.col("price"), F.col("beyond")
    up = (F.col("condition") == "above") & (target > beyond) & (target <= price)
    down = (F.col("condition") == "below") & (target < beyond) & (target >= price)
    crossed = records.join(active, ["ticker", "condition", "share"]).where(up | down)
    columns = ["alert_id", "ticker", "condition", "target_price", "price", "ts", "seq"]
    crossed = crossed.select(*columns)
    fired = crossed.groupBy("alert_id").applyInPandasWithState(_once, crossed.schema, "seq long", "append", "NoTimeout")
    message = alert_message(F.col("ticker"), F.col("condition"), target, price)
    return fired.withColumns({"ts": F.timestamp_micros("ts"), "message": message})


def stream_rate_flags(requests: DataFrame, watermark: str = "1 minute", closing: dt.datetime | None = None, **options) -> DataFrame:
    return rate_flags(before_closing(requests.withWatermark("ts", watermark), closing), **options)


def stream_bars(ticks: DataFrame, width: str = "1 day", watermark: str = "1 hour", closing: dt.datetime | None = None) -> DataFrame:
    """Finished bars, emitted when the watermark passes their window."""
    return tick_bars(before_closing(ticks.withWatermark("ts", watermark), closing), width)


def stream_dedup(documents: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Documents (text, ts) whose content was not seen within the watermark."""
    keyed = documents.withColumns({"doc_key": doc_key(F.col("text")), "content_key": content_key(F.col("text"))})
    return keyed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["content_key"])


BALANCE_SCHEMA = "user_id string, spent double"
LEDGER_COLUMNS = ["user_id", "conv_id", "turn", "cost", "blocked", "credits_remaining"]


def stream_credit_ledger(
    answers: DataFrame, ledger_path: str, balance_path: str, checkpoint: str, start: float = START_CREDITS, merge_every: int = MERGE_EVERY
):
    """Credit ledger of a stream, with each user's spending carried from batch to batch.

    Answers are charged in arrival order of the micro-batches and by (conv_id, turn) inside one.  A micro-batch
    is charged by the batch operator, in blocks of equal size, so one user's share is spread over tasks however
    large it is; what its users have spent is written with it and read by the next.  A replayed batch starts from
    the balances before it and overwrites its own rows.
    """
    balances = MergedTable(balance_path, ("user_id",), BALANCE_SCHEMA)

    def charge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        charged = credit_ledger(batch, start, balances.read(spark, before=batch_id)).select(*LEDGER_COLUMNS)
        path = _batch_path(ledger_path, batch_id)
        charged.write.mode("overwrite").parquet(path)
        ledger = spark.read.schema(charged.schema).parquet(path)
        balances.append(ledger.groupBy("user_id").agg((F.lit(start) - F.min("credits_remaining")).alias("spent")), batch_id)
        if (batch_id + 1) % merge_every == 0:
            balances.merge(spark)

    return answers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(charge)

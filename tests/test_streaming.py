"""Streams over several micro-batches: same rows as the batch operator, nothing added by a restart."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from quantframe.operators.bars import tick_bars
from quantframe.operators.chat import credit_ledger
from quantframe.sources.merged import MergedTable
from quantframe.streaming import jobs


def land(spark, rows, schema, path, name, fmt="parquet"):
    """Write one file per call, with increasing file times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").format(fmt).save(str(path))
    time.sleep(0.05)


TICKS = "ticker string, ts timestamp, seq long, price double"


def land_ticks(spark, source, rows, name):
    """One file of ticks, later than the files before."""
    frame = spark.createDataFrame([("SPY", i, p) for i, p in rows], "ticker string, seq long, price double")
    frame = frame.select("ticker", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")).alias("ts"), "seq", "price")
    frame.coalesce(1).write.mode("append").parquet(source)
    time.sleep(0.05)


def fire(spark, tmp_path, source, alerts, per_batch, name):
    out, checkpoint = (str(tmp_path / f"{n}-{name}") for n in ("fired", "checkpoint"))
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", per_batch).parquet(source)
    jobs.drain(jobs.stream_alerts(stream, alerts).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    return sorted((r.alert_id, r.price, r.seq) for r in spark.read.parquet(out).collect())


def test_alerts_fire_at_first_crossing_whatever_the_batch(spark, tmp_path):
    alerts = spark.createDataFrame(
        [(1, "SPY", 10.0, "above", "active"), (2, "SPY", 5.0, "below", "active"), (3, "QQQ", 1.0, "above", "active"),
         (4, "SPY", 1.0, "above", "cancelled"), (5, "SPY", 11.5, "above", "active"), (6, "SPY", 4.0, "below", "active"), (7, "SPY", 99.0, "above", "active")],
        "alert_id int, ticker string, target_price double, condition string, status string",
    )
    prices = [7, 8, 11, 6, None, 0, 12, 11, 7, 4.5, 9, 4, 3, 13, 7, 7, 7, 7, 7, 7]
    source = str(tmp_path / "ticks")
    for i in range(0, 20, 2):
        # the ticks of a file come in no order
        land_ticks(spark, source, [(j, float(prices[j]) if prices[j] is not None else None) for j in (i + 1, i)], str(i))
    want = [(1, 11.0, 2), (2, 4.5, 9), (5, 12.0, 6), (6, 4.0, 11)]
    assert fire(spark, tmp_path, source, alerts, 1, "one") == want
    assert fire(spark, tmp_path, source, alerts, 10, "ten") == want
    land_ticks(spark, source, [(30, 50.0), (31, 1.0)], "more")
    assert fire(spark, tmp_path, source, alerts, 1, "one") == want  # a restart fires nothing again


def test_records_are_new_highs_and_lows(spark):
    """Over many record batches, and against a plain walk through the ticks."""
    import random

    rng, ticks = random.Random(3), []
    for seq in range(3000):
        ticks.append((rng.choice("AB"), 1000 + seq // 3, seq, rng.gauss(100, 5)))
    rng.shuffle(ticks)
    frame = spark.createDataFrame(ticks, "ticker string, ts long, seq long, price double").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {tuple(r) for r in frame.mapInArrow(jobs._records, jobs.RECORD_SCHEMA).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want, best = set(), {}
    for t, ts, seq, p in sorted(ticks, key=lambda x: (x[1], x[2])):
        high, low = best.get(t, (float("-inf"), float("inf")))
        if p > high:
            want.add((t, "above", ts, seq, p, high))
        if p < low:
            want.add((t, "below", ts, seq, p, low))
        best[t] = (max(high, p), min(low, p))
    assert got == want


def test_credit_ledger_carries_balances_between_batches(spark, tmp_path):
    schema = "user_id string, conv_id long, turn long, model string, is_cached boolean"
    rows = [(u, c, t, "gemini-3.1-pro-preview", False) for c in range(6) for t in range(5) for u in ("u", "v")]
    source, out, balances, checkpoint = (str(tmp_path / n) for n in ("in", "out", "balances", "checkpoint"))
    for part in (rows[:16], rows[16:38], rows[38:40], rows[40:]):
        land(spark, part, schema, source, "a")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.drain(jobs.stream_credit_ledger(stream, out, balances, checkpoint, merge_every=2))
    got = {(r.user_id, r.conv_id, r.turn): (r.cost, r.blocked, r.credits_remaining) for r in spark.read.parquet(out).collect()}
    batch = credit_ledger(spark.createDataFrame(rows, schema))
    assert got == {(r.user_id, r.conv_id, r.turn): (r.cost, r.blocked, r.credits_remaining) for r in batch.collect()}
    assert sum(b for _, b, _ in got.values()) == 20


def test_retry_waits_on_timers_then_dead_letters(spark, tmp_path):
    schema = "body string, at timestamp"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    heals = lambda bodies, tries: bodies.map(lambda b: b.startswith("flaky") and tries >= 2)

    def rows(bodies, second):
        frame = spark.createDataFrame([(b,) for b in bodies], "body string")
        frame.select("body", F.timestamp_seconds(F.lit(1_700_000_000 + second)).alias("at")).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)

    def run():
        failed = F.col("body").startswith("flaky") | F.col("body").startswith("bad")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        result = jobs.stream_retry(stream, failed, heals)
        jobs.drain(result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
        return sorted((r.body, r.retry_count, r.outcome) for r in spark.read.parquet(out).collect())

    rows(["good", "flaky 1", "bad"], 0)
    rows(["flaky 2", "good", "bad 2", "bad 2"], 3)
    first = [("bad", 0, "again"), ("bad 2", 0, "again"), ("bad 2", 0, "again"), ("flaky 1", 0, "again"), ("flaky 2", 0, "again"), ("good", 0, "done"), ("good", 0, "done")]
    assert run() == first
    rows([None], 9)  # not due yet: nothing is written
    assert run() == first
    rows([None], 12)  # the first file's messages are due, the second's are not
    assert run() == sorted([*first, ("bad", 1, "again"), ("flaky 1", 1, "again")])
    for second in (24, 36, 48, 60):
        rows([None], second)
        got = run()
    later = [("bad", i, "again") for i in (1, 2)] + 2 * [("bad 2", i, "again") for i in (1, 2)] + [(f"flaky {j}", 1, "again") for j in (1, 2)]
    ends = [("bad", 3, "dead"), ("bad 2", 3, "dead"), ("bad 2", 3, "dead"), ("flaky 1", 2, "done"), ("flaky 2", 2, "done")]
    assert got == sorted([*first, *later, *ends])


def test_closing_row_ends_every_window(spark, tmp_path):
    schema = "ticker string, ts timestamp, seq long, price double, qty double"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    hours = spark.range(80).select(
        F.lit("SPY").alias("ticker"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts"),
        F.col("id").alias("seq"), F.col("id").cast("double").alias("price"), F.lit(1.0).alias("qty"),
    )
    hours.coalesce(1).write.parquet(source)
    time.sleep(0.05)
    last = hours.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts"))
    closing = last.first()["ts"]
    last.select(F.lit(None).cast("string").alias("ticker"), "ts", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("qty")).write.mode("append").parquet(source)
    stream = jobs.stream_bars(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), closing=closing)
    jobs.drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    got = spark.read.parquet(out).select("ticker", "w.start", "open", "high", "low", "close", "volume").collect()
    want = tick_bars(hours).select("ticker", "w.start", "open", "high", "low", "close", "volume").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 3


def test_merged_table_reads_no_superseded_batch(spark, tmp_path):
    table = MergedTable(str(tmp_path / "t"), ("ns", "id"), "ns string, id long, v string", buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, table.schema)
    state = lambda before=None: {(r.ns, r.id): r.v for r in table.read(spark, before).collect()}
    assert state() == {} and table.version(spark) == -1
    table.merge(spark)
    want = {}
    for n in range(7):
        rows = [("a" if i % 2 else "b", i, f"{n}") for i in range(n, 40, n + 1)]
        table.append(batch(rows), n)
        want |= {(ns, i): v for ns, i, v in rows}
        assert state() == want
        if n in (1, 4):
            before = table.version(spark)
            table.merge(spark)
            assert table.version(spark) == n > before and state() == want
            table.merge(spark)  # nothing is open: nothing changes
            assert table.version(spark) == n
    table.append(batch([("a", 1, "6b"), ("a", 1, "6b")]), 6)  # a replayed batch overwrites its own rows
    assert state()[("a", 1)] == "6b"
    old = state(before=5)
    table.drop_superseded(spark)
    assert {n for n in (tmp_path / "t" / "open").iterdir()} == {tmp_path / "t" / "open" / f"batch_id={n}" for n in (5, 6)}
    assert state()[("a", 1)] == "6b" and state(before=5) == old
    paths = "".join(table.read(spark).inputFiles())
    assert "batch_id=4" not in paths and "batch_id=6" in paths


def test_enriched_repeats_collapse(spark, tmp_path):
    queue, vectors, checkpoint = (str(tmp_path / n) for n in ("queue", "vectors", "checkpoint"))
    body = json.dumps({"text": "one. two", "published_at": 1.0, "url": "u", "tickers": ["SPY", "TLT"]})
    os.makedirs(queue)
    score = lambda df: df.withColumns({"sentiment": F.lit("NEUTRAL"), "sentiment_score": F.lit(0.5)})
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    for i in range(2):
        (tmp_path / "queue" / f"{i}.txt").write_text(body)
        jobs.drain(jobs.stream_enrich(jobs.queue_source(spark, queue), vectors, checkpoint, score, embed))
    record = jobs.read_vectors(spark, vectors).collect()
    assert len(record) == 1
    assert (record[0].ticker_principal, record[0].tickers_relacionados) == ("SPY", "SPY,TLT")

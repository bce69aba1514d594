"""Queries over the bar table, the prediction loop and file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe import fixtures
from quantframe.functions import reports as rp
from quantframe.functions import signals as sg
from quantframe.operators import bars as br
from quantframe.operators import features as ft
from quantframe.operators import predictions as pr
from quantframe.operators import tables as tb
from quantframe.plans.evaluation_queries import _CONVICTION_SQL
from quantframe.plans.oracle_views import BARS, BUY_AT, FEATURES, SELL_AT, SIGNALS
from quantframe.plans.panel_queries import PANEL_SQL, round_all
from quantframe.plans.registry import query
from quantframe.session import passing, shared_dir, staged
from quantframe.sources import files

OHLCV = ["ticker", "date", "open", "high", "low", "close", "volume"]
_OHLCV = ", ".join(OHLCV)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.bars(spark, sf_dir).select(*OHLCV)


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("ohlcv_melt", f"WITH {BARS} SELECT {_OHLCV} FROM bars")
def ohlcv_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.first(f).alias(f.title()) for f in br.FIELDS]
    bars = _bars(spark, sf_dir)
    tickers = [r.ticker for r in bars.select("ticker").distinct().orderBy("ticker").collect()]  # columns of the wide frame
    wide = bars.groupBy("date").pivot("ticker", tickers).agg(*fields)
    return br.ohlcv_melt(wide, tickers)


@query("panel_store", f"WITH {BARS} SELECT {_OHLCV} FROM bars")
def panel_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "panel")
    files.write_panel(_bars(spark, sf_dir), path)
    return files.read_panel(spark, path).select(*OHLCV)


def _lookback_sql(days: int) -> str:
    return f"SELECT {days} AS lookback, ticker, date, close FROM bars, d WHERE date BETWEEN day - {days} AND day"


@query(
    "lookback_scan",
    f"WITH {BARS}, d AS (SELECT max(date) AS day FROM bars) {' UNION ALL '.join(_lookback_sql(n) for n in (300, 540, 1760))}",
)
def lookback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    newest = bars.agg(F.max("date")).scalar()
    parts = [
        br.lookback_scan(bars, newest, n).select(F.lit(n).alias("lookback"), "ticker", "date", "close")
        for n in (300, 540, 1760)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# a new batch: the last five days of the table, repriced
_BATCH_SQL = f"""{BARS},
batch AS (SELECT ticker, date, open, high, low, close * 1.5::DOUBLE AS close, volume FROM bars
 WHERE date > (SELECT max(date) FROM bars) - 5)"""


def _batch(bars: DataFrame) -> DataFrame:
    newest = bars.agg(F.max("date")).scalar()
    return bars.filter(F.col("date") > F.date_sub(newest, 5)).withColumn("close", F.col("close") * 1.5)


@query("full_refresh", f"WITH {_BATCH_SQL} SELECT {_OHLCV} FROM batch")
def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    path = _path(spark, "market")
    files.write_panel(bars, path)
    files.write_panel(tb.full_refresh(bars, _batch(bars)), path)
    return files.read_panel(spark, path).select(*OHLCV)


@query(
    "range_replace",
    f"WITH {_BATCH_SQL}, s AS (SELECT min(date) AS lo, max(date) AS hi FROM batch)"
    f" SELECT {_OHLCV} FROM bars, s WHERE NOT (ticker IN (SELECT ticker FROM batch) AND date BETWEEN lo AND hi)"
    f" UNION ALL SELECT {_OHLCV} FROM batch",
)
def range_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    return br.range_replace(bars, _batch(bars))


@query(
    "batch_bounds",
    f"WITH {_BATCH_SQL} SELECT DISTINCT ticker, (SELECT min(date) FROM batch) AS min_date, (SELECT max(date) FROM batch) AS max_date FROM batch",
)
def batch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.batch_bounds(_batch(_bars(spark, sf_dir)))


# a raw feed: index under its feed name with volume 0, holes by volume, some bars without trades
_RAW_SQL = f"""{BARS},
raw AS (
 SELECT CASE WHEN ticker = 'VIX' THEN '^VIX' ELSE ticker END AS ticker, date, open, high, low,
  CASE WHEN volume < 20 THEN NULL ELSE close END AS close,
  CASE WHEN ticker = 'VIX' OR volume > 90 THEN 0.0 ELSE volume END AS volume FROM bars)"""


def _raw(bars: DataFrame) -> DataFrame:
    is_vix = F.col("ticker") == "VIX"
    return bars.select(
        F.when(is_vix, "^VIX").otherwise(F.col("ticker")).alias("ticker"), "date", "open", "high", "low",
        F.when(F.col("volume") >= 20, F.col("close")).alias("close"),
        F.when(is_vix | (F.col("volume") > 90), 0.0).otherwise(F.col("volume")).alias("volume"),
    )


@query(
    "clean_bars",
    f"WITH {_RAW_SQL}, c AS (SELECT max(date) - 1 AS cut FROM raw)"
    " SELECT CASE WHEN ticker = '^VIX' THEN 'VIX' ELSE ticker END AS ticker, date, open, high, low, close, volume,"
    " close AS adj_close FROM raw, c WHERE close IS NOT NULL AND date <= cut AND (ticker = '^VIX' OR volume > 0)",
)
def clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(_bars(spark, sf_dir))
    return br.clean_bars(raw, F.date_sub(raw.agg(F.max("date")).scalar(), 1))


@query("adj_close_default", f"WITH {BARS} SELECT ticker, date, close, close AS adj_close FROM bars")
def adj_close_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.adj_close_default(_bars(spark, sf_dir)).select("ticker", "date", "close", "adj_close")


# all events fall in January, when New York is five hours behind UTC
@query(
    "market_cutoff",
    "SELECT event_id, CASE WHEN hour(ts - INTERVAL 5 HOUR) < 16 THEN CAST(ts - INTERVAL 5 HOUR AS DATE) - 1"
    " ELSE CAST(ts - INTERVAL 5 HOUR AS DATE) END AS cutoff FROM events",
)
def market_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.table(spark, sf_dir, "events")
    return events.select("event_id", br.market_cutoff(F.col("ts")).alias("cutoff"))


@query("panel_union", f"WITH {_BATCH_SQL} SELECT {_OHLCV} FROM bars UNION ALL SELECT {_OHLCV} FROM batch")
def panel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    return bars.unionByName(_batch(bars))


@query("distinct_tickers", f"WITH {BARS} SELECT DISTINCT ticker FROM bars")
def distinct_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).select("ticker").distinct()


REQUIRED = ["ret_1d", "ret_20d", "dist_sma_50", "rsi_14", "natr_14"]


@query(
    "null_guard",
    f"WITH {FEATURES} SELECT ticker, date, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in REQUIRED)
    + ") AS missing FROM feats WHERE "
    + " OR ".join(f"{c} IS NULL" for c in REQUIRED),
)
def null_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = ft.feature_frame(fixtures.bars(spark, sf_dir), ["log_returns", "dist_sma", "rsi", "natr"])
    return ft.null_report(frame, REQUIRED)


_LATEST = f"SELECT * FROM ({PANEL_SQL}) q QUALIFY date = max(date) OVER ()"


@query("latest_cross_section", _LATEST)
def latest_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    with passing(spark) as keep:
        panel = ft.feature_panel(fixtures.bars(spark, sf_dir), inference=True)
        return round_all(keep(ft.latest_cross_section(panel)), [*ft.FEATURES, "fwd_log_return"])


@query(
    "leak_safe_projection",
    f"WITH {FEATURES} SELECT ticker, date, close, round(ret_1d, 9) AS ret_1d, round(candle_body, 6) AS candle_body,"
    " round(fwd_log_return, 9) AS fwd_log_return FROM feats",
)
def leak_safe_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute prices, volume and surrogate columns are gone; only allow-listed features stay."""
    frame = ft.feature_frame(fixtures.bars(spark, sf_dir), ["log_returns", "candles", "forward_return"])
    safe = ft.leak_safe(frame).drop("ret_3d", "ret_5d", "ret_10d", "ret_14d", "ret_20d", "upper_shadow", "lower_shadow")
    return round_all(round_all(safe, ["ret_1d", "fwd_log_return"], 9), ["candle_body"])


@query(
    "feature_snapshot",
    f"WITH {FEATURES} SELECT ticker, date AS signal_date, round(ret_1d, 9) AS ret_1d, round(natr_14, 6) AS natr_14"
    " FROM feats WHERE natr_14 IS NOT NULL",
)
def feature_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = ft.feature_frame(fixtures.bars(spark, sf_dir), ["log_returns", "natr"]).dropna(subset=["natr_14"])
    rows = frame.select(
        "ticker", F.col("date").alias("signal_date"),
        F.round("ret_1d", 9).alias("feat_ret_1d"), F.round("natr_14", 6).alias("feat_natr_14"),
    )
    path = _path(spark, "snapshot")
    files.write_snapshot(files.feature_snapshot(rows), path)
    schema = "ticker string, signal_date date, ret_1d double, natr_14 double"
    return spark.read.schema(schema).csv(path, header=True)


@query("staging_parquet", f"WITH {FEATURES} SELECT ticker, date, round(natr_14, 6) AS natr_14 FROM feats WHERE natr_14 IS NOT NULL")
def staging_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = ft.feature_frame(fixtures.bars(spark, sf_dir), ["natr"]).dropna(subset=["natr_14"])
    return staged(round_all(frame.select("ticker", "date", "natr_14"), ["natr_14"]))


@query(
    "load_manifest",
    f"WITH {SIGNALS} SELECT round(quantile_cont(fwd_log_return, 0.693799087600558), 9) AS bull_limit,"
    " round(quantile_cont(fwd_log_return, 0.25020639959880264), 9) AS bear_limit,"
    f" {BUY_AT} AS buy_threshold, {SELL_AT} AS sell_threshold, 'ret_1d,natr_14' AS features,"
    " 1.8039724530062737::DOUBLE AS sell_weight FROM signals",
)
def load_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits fitted on all signals go through a written manifest; class weights are re-keyed as integers."""
    from quantframe.operators.labels import quantile_thresholds

    known = staged(fixtures.signals(spark, sf_dir).filter(F.col("fwd_log_return").isNotNull()))
    limits = quantile_thresholds(known, (), fixtures.Q_HIGH_ORIGINAL, fixtures.Q_LOW_ORIGINAL)
    fixed = files.manifest_frame(
        spark,
        {
            "buy_threshold": fixtures.BUY_AT,
            "sell_threshold": fixtures.SELL_AT,
            "req_features": ["ret_1d", "natr_14"],
            # fixed values: class weights
            "class_weight": {"-1": 1.8039724530062737, "0": 1.2888522813537968, "1": 1.400465297257751},
        },
    )
    fitted = limits.select(F.struct("high", "low")).scalar()
    path = _path(spark, "manifest")
    files.write_manifest(fixed.withColumns({"bull_limit": fitted["high"], "bear_limit": fitted["low"]}), path)
    loaded = files.load_manifest(spark, path)
    weights = F.transform_keys("class_weight", lambda k, v: k.cast("int"))
    return loaded.select(
        F.round("bull_limit", 9).alias("bull_limit"), F.round("bear_limit", 9).alias("bear_limit"),
        "buy_threshold", "sell_threshold", F.array_join("req_features", ",").alias("features"),
        weights[F.lit(-1)].alias("sell_weight"),
    )


PREDICTIONS_SQL = f"""{SIGNALS},
zones AS (SELECT *, {_CONVICTION_SQL} FROM signals),
predictions AS MATERIALIZED (
 SELECT ticker || '#' || lpad(bar_no::VARCHAR, 9, '0') AS id, date + 1 AS prediction_date, date AS signal_date, ticker,
  ml_decision AS quant_decision, probability AS quant_probability, conviction_zone, 'volume,range' AS top_drivers,
  close AS pred_close_price, leaning_action AS llm_verdict, NULL::DOUBLE AS actual_close_price,
  NULL::DOUBLE AS realized_return, 'PENDING' AS reconciliation_status FROM zones),
t AS (SELECT max(date) - 30 AS target FROM bars),
asof_ AS (
 SELECT p.*, (SELECT arg_min(b.close, b.date) FROM bars b, t WHERE b.ticker = p.ticker AND b.date > p.signal_date
   AND b.date <= target) AS next_close FROM predictions p, t WHERE prediction_date < target),
reconciled AS MATERIALIZED (
 SELECT *, ln(next_close / pred_close_price) AS gain,
  CASE WHEN ln(next_close / pred_close_price) >= 0.0053093753051493085::DOUBLE THEN 'BUY'
   WHEN ln(next_close / pred_close_price) <= -0.005749496635898443::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS true_label
 FROM asof_ WHERE next_close IS NOT NULL)"""


def _target(bars: DataFrame):
    return F.date_sub(bars.agg(F.max("date")).scalar(), 30)


def _reconciled(spark: SparkSession, sf_dir: str):
    bars = fixtures.bars(spark, sf_dir)
    predictions = staged(fixtures.predictions(spark, sf_dir, bars))
    done = pr.reconcile(predictions, bars, _target(bars), fixtures.BULL_LIMIT, fixtures.BEAR_LIMIT)
    return bars, predictions, done


@query("next_close_asof", f"WITH {PREDICTIONS_SQL} SELECT id, next_close FROM asof_")
def next_close_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixtures.bars(spark, sf_dir)
    predictions = staged(fixtures.predictions(spark, sf_dir, bars))
    target = _target(bars)
    return pr.next_close_asof(pr.pending(predictions, target), bars, target).select("id", "next_close")


@query(
    "reconcile",
    f"WITH {PREDICTIONS_SQL} SELECT round(avg(CASE WHEN llm_verdict IN ('BUY', 'SELL') THEN (llm_verdict = true_label)::INT END), 9) AS win_rate,"
    " round(avg(CASE llm_verdict WHEN 'BUY' THEN gain WHEN 'SELL' THEN -gain END), 9) AS avg_return,"
    " count_if(llm_verdict IN ('BUY', 'SELL'))::BIGINT AS volume, count(*) AS reconciled FROM reconciled",
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = _reconciled(spark, sf_dir)
    return round_all(pr.reconcile_summary(done), ["win_rate", "avg_return"], 9)


@query(
    "apply_reconciliation",
    f"WITH {PREDICTIONS_SQL} SELECT p.id, p.llm_verdict, r.next_close AS actual_close_price, round(r.gain, 9) AS realized_return,"
    " CASE WHEN r.id IS NULL THEN 'PENDING' ELSE 'RECONCILED' END AS reconciliation_status"
    " FROM predictions p LEFT JOIN reconciled r ON r.id = p.id",
)
def apply_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, predictions, done = _reconciled(spark, sf_dir)
    table = pr.apply_reconciliation(predictions, staged(done))
    columns = ["id", "llm_verdict", "actual_close_price", "realized_return", "reconciliation_status"]
    return round_all(table.select(*columns), ["realized_return"], 9)


_RECENT_SQL = f"""{PREDICTIONS_SQL},
recent AS (SELECT * FROM reconciled, t WHERE quant_decision <> 'HOLD' AND prediction_date <= target
 ORDER BY prediction_date DESC, id DESC LIMIT 20)"""


@query("recent_n", f"WITH {_RECENT_SQL} SELECT id, quant_decision, prediction_date, round(gain, 9) AS realized_return FROM recent")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, _, done = _reconciled(spark, sf_dir)
    recent = pr.recent_reconciled(done, _target(bars))
    return round_all(recent.select("id", "quant_decision", "prediction_date", "realized_return"), ["realized_return"], 9)


@query(
    "drift_check",
    f"WITH {_RECENT_SQL}, s AS (SELECT count(*) AS sample, avg(((quant_decision = 'BUY' AND gain > 0) OR (quant_decision = 'SELL' AND gain < 0))::INT) AS win_rate FROM recent)"
    " SELECT sample, round(win_rate, 9) AS win_rate, CASE WHEN sample < 20 THEN 'insufficient' WHEN win_rate >= 0.45 THEN 'healthy' ELSE 'drift' END AS status FROM s",
)
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, _, done = _reconciled(spark, sf_dir)
    return round_all(pr.drift_check(done, _target(bars)), ["win_rate"], 9)


@query(
    "upsert_predictions",
    f"WITH {PREDICTIONS_SQL}, m AS (SELECT max(signal_date) AS d FROM predictions)"
    " SELECT ticker, signal_date, CASE WHEN signal_date = d THEN 'HOLD' ELSE llm_verdict END AS llm_verdict, reconciliation_status FROM predictions, m",
)
def upsert_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-run of the latest day: its rows are replaced and pending again."""
    base = staged(fixtures.predictions(spark, sf_dir))
    newest = base.agg(F.max("signal_date")).scalar()
    rerun = base.filter(F.col("signal_date") == newest).withColumn("llm_verdict", F.lit("HOLD"))
    table = tb.upsert(base, rerun, ["signal_date", "ticker"])
    return table.select("ticker", "signal_date", "llm_verdict", "reconciliation_status")


_VERDICT_SQL = f"""{SIGNALS},
zones AS (SELECT *, volume > 60 AS has_news, CASE WHEN volume > 95 THEN NULL WHEN volume > 80 THEN ' buy now '
  WHEN volume > 70 THEN 'Sell.' WHEN volume > 40 THEN 'hold' ELSE 'unsure' END AS answer, {_CONVICTION_SQL} FROM signals),
asked AS (SELECT *, conviction_zone = 'HOT' OR (conviction_zone = 'GREY' AND has_news) AS consulted,
  CASE WHEN contains(upper(answer), 'BUY') THEN 'BUY' WHEN contains(upper(answer), 'SELL') THEN 'SELL'
   WHEN contains(upper(answer), 'HOLD') THEN 'HOLD' ELSE upper(trim(answer)) END AS parsed FROM zones),
verdicts AS (SELECT *, CASE WHEN NOT consulted THEN 'HOLD' WHEN answer IS NOT NULL THEN parsed
  WHEN conviction_zone = 'HOT' AND NOT has_news THEN leaning_action ELSE 'HOLD' END AS verdict FROM asked)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = sg.conviction(F.col("prob_buy"), F.col("prob_sell"), fixtures.BUY_AT, fixtures.SELL_AT)
    signals = staged(fixtures.signals(spark, sf_dir))
    scored = signals.select("ticker", "date", *[c.alias(n) for n, c in zones.items()])
    joined = scored.join(fixtures.verdict_answers(signals), ["ticker", "date"], "left")
    zone, news = F.col("conviction_zone"), F.col("has_news")
    return joined.withColumns(
        {"verdict": sg.verdict(zone, news, F.col("leaning_action"), F.col("answer")), "consulted": sg.consults(zone, news)}
    )


@query("verdict_join", f"WITH {_VERDICT_SQL} SELECT ticker, date, conviction_zone, has_news, verdict FROM verdicts")
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("ticker", "date", "conviction_zone", "has_news", "verdict")


_AUDIT_SQL = (
    "ticker || ' on ' || date || chr(10) || chr(10) || '| step | outcome |' || chr(10) || '| --- | --- |' || chr(10)"
    " || '| model | ' || ml_decision || ' |' || chr(10) || '| leaning | ' || leaning_action || ' |' || chr(10)"
    " || '| zone | ' || conviction_zone || ' |' || chr(10) || '| probability | ' || printf('%.2f', probability * 100) || '% |' || chr(10)"
    " || '| drivers | volume, range |' || chr(10) || '| second opinion | ' || CASE WHEN consulted THEN 'asked' ELSE 'not asked' END || ' |' || chr(10)"
    f" || '| verdict | ' || verdict || ' |' || chr(10) || chr(10) || 'News:' || chr(10) || '{rp.NO_NEWS}' || chr(10)"
)


@query("audit_markdown", f"WITH {_VERDICT_SQL} SELECT ticker, date, {_AUDIT_SQL} AS report FROM verdicts")
def audit_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written by ticker and year, twice as a repeated run would, and read back."""
    report = rp.audit_markdown(
        F.col("ticker"), F.col("date"), F.col("ml_decision"), F.col("leaning_action"), F.col("conviction_zone"),
        F.col("probability"), F.lit("volume, range"), F.col("verdict"), F.col("consulted"), F.lit(rp.NO_NEWS),
    )
    path = _path(spark, "reports")
    with passing(spark):
        with passing(spark) as keep:
            reports = keep(_verdicts(spark, sf_dir).select("ticker", "date", report.alias("report")))
        for _ in range(2):
            files.write_reports(reports, path, "yyyy")
    return files.read_reports(spark, path)


@query(
    "list_codec",
    f"WITH {PREDICTIONS_SQL} SELECT id, 'volume' AS first_driver, 2::INTEGER AS n_drivers, 'range,volume' AS joined FROM predictions",
)
def list_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    drivers = F.split("top_drivers", ",")
    return fixtures.predictions(spark, sf_dir).select(
        "id", drivers[0].alias("first_driver"), F.size(drivers).alias("n_drivers"),
        F.concat_ws(",", F.sort_array(drivers)).alias("joined"),
    )


@query(
    "tick_bars",
    "WITH p AS (SELECT CASE user_id % 7 WHEN 0 THEN 'SPY' WHEN 1 THEN 'QQQ' WHEN 2 THEN 'DIA' WHEN 3 THEN 'GLD' WHEN 4 THEN 'TLT'"
    " WHEN 5 THEN 'IWM' ELSE 'VIX' END AS ticker, ts, event_id, value FROM events)"
    " SELECT ticker, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,"
    " arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM p GROUP BY ticker, CAST(ts AS DATE)",
)
def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = br.tick_bars(fixtures.price_ticks(spark, sf_dir))
    return bars.select("ticker", F.to_date("w.start").alias("day"), "open", "high", "low", "close", "volume")

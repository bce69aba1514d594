"""Queries over labels, folds, portfolio metrics and classification quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe import fixtures
from quantframe.functions import signals as sg
from quantframe.operators import classification as cl
from quantframe.operators import labels as lb
from quantframe.operators import portfolio as pf
from quantframe.operators.timeline import dense_dates
from quantframe.plans.oracle_views import BEAR, BULL, BUY_AT, DAILY, OUTCOMES, SELL_AT, SIGNALS
from quantframe.plans.panel_queries import round_all
from quantframe.plans.registry import query
from quantframe.session import shared_dir, staged
from quantframe.sources import files

SHARPE_SQL = "sqrt(252.0::DOUBLE) * avg(strategy_return) / (stddev_pop(strategy_return) + 1e-8)"


def _digits(columns: list[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query(
    "quantile_thresholds",
    f"WITH {OUTCOMES} SELECT round(high, 9) AS high, round(low, 9) AS low FROM limits",
)
def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = staged(fixtures.signals(spark, sf_dir).filter(F.col("fwd_log_return").isNotNull()))
    return round_all(lb.quantile_thresholds(known), ["high", "low"], 9)


@query(
    "label",
    f"WITH {SIGNALS} SELECT ticker, date, CASE WHEN fwd_log_return > {BULL} THEN 1 WHEN fwd_log_return < {BEAR} THEN -1"
    f" ELSE 0 END AS strict_label, CASE WHEN fwd_log_return >= {BULL} THEN 1 WHEN fwd_log_return <= {BEAR} THEN -1"
    " ELSE 0 END AS inclusive_label FROM signals WHERE fwd_log_return IS NOT NULL",
)
def label(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fixtures.signals(spark, sf_dir).filter(F.col("fwd_log_return").isNotNull())
    value, limits = F.col("fwd_log_return"), (fixtures.BULL_LIMIT, fixtures.BEAR_LIMIT)
    return known.select(
        "ticker", "date",
        sg.label(value, *limits).alias("strict_label"),
        sg.label(value, *limits, inclusive=True).alias("inclusive_label"),
    )


@query(
    "label_by_quantiles",
    f"WITH {OUTCOMES} SELECT y_true, count(*) AS n, min(date) AS first_date, max(date) AS last_date"
    " FROM outcomes GROUP BY y_true",
)
def label_by_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.outcomes(spark, sf_dir).groupBy("y_true").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "portfolio_daily",
    f"WITH {DAILY} SELECT date, {_digits(['market_return', 'strategy_return'], 9)} FROM daily",
)
def portfolio_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = pf.portfolio_daily(fixtures.outcomes(spark, sf_dir))
    return round_all(daily, ["market_return", "strategy_return"], 9)


@query(
    "equity_curve",
    f"WITH {DAILY} SELECT date, round(equity, 6) AS equity, round(running_max, 6) AS running_max,"
    " round((equity - running_max) / running_max, 6) AS drawdown FROM curve",
)
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = pf.equity_curve(pf.portfolio_daily(fixtures.outcomes(spark, sf_dir)))
    return round_all(curve.select("date", "equity", "running_max", "drawdown"), ["equity", "running_max", "drawdown"])


@query(
    "cum_return",
    f"WITH {DAILY} SELECT round(exp(sum(strategy_return)) - 1, 6) AS total_return_strat,"
    " round(exp(sum(market_return)) - 1, 6) AS total_return_market FROM daily",
)
def cum_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = pf.portfolio_daily(fixtures.outcomes(spark, sf_dir))
    totals = daily.agg(
        (F.exp(F.sum("strategy_return")) - 1).alias("total_return_strat"),
        (F.exp(F.sum("market_return")) - 1).alias("total_return_market"),
    )
    return round_all(totals, totals.columns)


@query("max_drawdown", f"WITH {DAILY} SELECT round(min((equity - running_max) / running_max), 6) AS max_drawdown FROM curve")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = pf.equity_curve(pf.portfolio_daily(fixtures.outcomes(spark, sf_dir)))
    return curve.agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"))


@query("sharpe", f"WITH {DAILY} SELECT round({SHARPE_SQL}, 6) AS sharpe_ratio FROM daily")
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = pf.portfolio_daily(fixtures.outcomes(spark, sf_dir))
    ratio = pf.sharpe(F.avg("strategy_return"), F.stddev_pop("strategy_return"))
    return daily.agg(F.round(ratio, 6).alias("sharpe_ratio"))


METRIC_COLUMNS = ["total_return_strat", "total_return_market", "max_drawdown", "sharpe_ratio"]
METRICS_SQL = (
    "exp(sum(strategy_return)) - 1 AS total_return_strat, exp(sum(market_return)) - 1 AS total_return_market,"
    f" min((equity - running_max) / running_max) AS max_drawdown, {SHARPE_SQL} AS sharpe_ratio"
)


@query(
    "portfolio_metrics",
    f"WITH {DAILY}, m AS (SELECT {METRICS_SQL} FROM curve) SELECT {_digits(METRIC_COLUMNS, 6)} FROM m",
)
def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(pf.portfolio_metrics(fixtures.outcomes(spark, sf_dir)), METRIC_COLUMNS)


@query("accuracy", f"WITH {OUTCOMES} SELECT round(avg((y_true = y_pred)::INT), 9) AS accuracy FROM outcomes")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cl.accuracy(fixtures.outcomes(spark, sf_dir)), ["accuracy"], 9)


_REPORT_SQL = f"""WITH {OUTCOMES},
c AS (SELECT unnest([-1, 0, 1])::INTEGER AS class),
s AS (
 SELECT class, count_if(y_true = class AND y_pred = class)::BIGINT AS tp, count_if(y_pred = class)::BIGINT AS predicted,
   count_if(y_true = class)::BIGINT AS support FROM c, outcomes GROUP BY class),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS q FROM s)
SELECT class, round(p, 9) AS precision, round(q, 9) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0.0), 9) AS f1,
 support FROM r"""


@query("classification_report", _REPORT_SQL)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cl.classification_report(fixtures.outcomes(spark, sf_dir)), ["precision", "recall", "f1"], 9)


@query(
    "confusion_matrix",
    f"WITH {OUTCOMES}, t AS (SELECT unnest([-1, 0, 1])::INTEGER AS y_true), p AS (SELECT unnest([-1, 0, 1])::INTEGER AS y_pred),"
    " n AS (SELECT y_true, y_pred, count(*) AS n FROM outcomes GROUP BY ALL)"
    " SELECT t.y_true, p.y_pred, coalesce(n.n, 0) AS n FROM t, p LEFT JOIN n ON n.y_true = t.y_true AND n.y_pred = p.y_pred",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.confusion_matrix(fixtures.outcomes(spark, sf_dir))


_CALL_SQL = f"CASE WHEN prob_buy >= {BUY_AT} THEN 1 WHEN prob_sell >= {SELL_AT} THEN -1 ELSE 0 END"


@query(
    "actionable_accuracy",
    f"WITH {OUTCOMES}, called AS (SELECT *, {_CALL_SQL} AS c FROM outcomes) SELECT ticker,"
    " round(coalesce(avg(CASE WHEN c <> 0 THEN (c = y_true)::INT END), 0), 9) AS actionable_accuracy,"
    " count_if(c <> 0)::BIGINT AS n_actionable FROM called GROUP BY ticker",
)
def actionable_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cl.actionable_accuracy(fixtures.outcomes(spark, sf_dir), fixtures.BUY_AT, fixtures.SELL_AT, ["ticker"])
    return round_all(scored, ["actionable_accuracy"], 9)


@query(
    "coverage",
    f"WITH {OUTCOMES} SELECT round(avg((y_pred <> 0)::INT), 9) AS coverage, count(*) AS n_rows FROM outcomes",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(pf.coverage(fixtures.outcomes(spark, sf_dir)), ["coverage"], 9)


# trial thresholds around the production pair
TRIALS = [(0.30, 0.35), (0.40, 0.45), (0.45, 0.55), (0.55, 0.60), (0.70, 0.72), (0.78, 0.80)]

_TRIAL_ROWS = ", ".join(f"({i}, {b}::DOUBLE, {s}::DOUBLE)" for i, (b, s) in enumerate(TRIALS))
_TUNING_SQL = f"""WITH {OUTCOMES},
trials(trial, buy_at, sell_at) AS (VALUES {_TRIAL_ROWS}),
rows_ AS (
 SELECT trial, date, fwd_log_return, CASE WHEN prob_sell >= sell_at THEN -1 WHEN prob_buy >= buy_at THEN 1 ELSE 0 END AS p
 FROM outcomes, trials),
d AS (
 SELECT trial, date, avg(fwd_log_return) AS market_return,
   avg(CASE p WHEN 1 THEN fwd_log_return WHEN -1 THEN -fwd_log_return ELSE 0 END) AS strategy_return
 FROM rows_ GROUP BY trial, date),
v AS (SELECT *, exp(sum(strategy_return) OVER (PARTITION BY trial ORDER BY date)) AS equity FROM d),
u AS (SELECT *, max(equity) OVER (PARTITION BY trial ORDER BY date) AS running_max FROM v),
m AS (SELECT trial, {METRICS_SQL} FROM u GROUP BY trial),
c AS (SELECT trial, avg((p <> 0)::INT) AS coverage, count(*) AS n_rows FROM rows_ GROUP BY trial)
SELECT trial::INTEGER AS trial, {_digits(METRIC_COLUMNS, 6)}, round(coverage, 9) AS coverage, n_rows,
 round(CASE WHEN n_rows < 100 THEN -9999 ELSE total_return_strat * 100 + sharpe_ratio * 5
  - CASE WHEN coverage < 0.2 THEN (0.2 - coverage) * 1000 ELSE 0 END
  - CASE WHEN max_drawdown < -0.2 THEN 500 ELSE 0 END - CASE WHEN total_return_strat < 0 THEN 200 ELSE 0 END END, 4) AS score
FROM m JOIN c USING (trial)"""


def trial_rows(results: DataFrame, trials: list[tuple[float, float]]) -> DataFrame:
    """Re-threshold every row under each trial."""
    entries = [
        F.struct(
            F.lit(i).alias("trial"), sg.decide(F.col("prob_buy"), F.col("prob_sell"), b, s, "sell").alias("y_pred")
        )
        for i, (b, s) in enumerate(trials)
    ]
    return results.select("ticker", "date", "fwd_log_return", F.explode(F.array(*entries)).alias("t")).select(
        "ticker", "date", "fwd_log_return", "t.*"
    )


@query("tuning_score", _TUNING_SQL)
def tuning_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pf.tuning_score(trial_rows(fixtures.outcomes(spark, sf_dir), TRIALS))
    return round_all(round_all(round_all(scored, METRIC_COLUMNS), ["coverage"], 9), ["score"], 4)


_STATE_SQL = f"""WITH {OUTCOMES},
st AS (
 SELECT ticker, date, fwd_log_return, coalesce(last_value(nullif(y_pred, 0) IGNORE NULLS) OVER (
   PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1, false)::INT AS state
 FROM outcomes)
"""


@query(
    "position_state",
    f"{_STATE_SQL} SELECT ticker, date, state, round(CASE WHEN state = 1 THEN fwd_log_return ELSE 0 END, 9) AS pnl FROM st",
)
def position_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pf.position_state(fixtures.outcomes(spark, sf_dir))
    return round_all(held.select("ticker", "date", "state", "pnl"), ["pnl"], 9)


@query(
    "binary_portfolio",
    f"{_STATE_SQL}, k AS (SELECT count(DISTINCT ticker) AS k FROM outcomes)"
    " SELECT date, round(sum(CASE WHEN state = 1 THEN fwd_log_return ELSE 0 END) / any_value(k), 9) AS strategy_return,"
    " round(sum(fwd_log_return) / any_value(k), 9) AS market_return FROM st, k GROUP BY date",
)
def binary_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(pf.binary_portfolio(fixtures.outcomes(spark, sf_dir)), ["strategy_return", "market_return"], 9)


@query(
    "date_ticker_grid",
    f"WITH {OUTCOMES}, d AS (SELECT DISTINCT date FROM outcomes), t AS (SELECT DISTINCT ticker FROM outcomes)"
    " SELECT d.date, t.ticker, coalesce(o.y_pred, 0)::DOUBLE AS y_pred,"
    " round(coalesce(o.fwd_log_return, 0), 9) AS fwd_log_return FROM d CROSS JOIN t"
    " LEFT JOIN outcomes o ON o.date = d.date AND o.ticker = t.ticker",
)
def date_ticker_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = pf.date_ticker_grid(fixtures.outcomes(spark, sf_dir), ["y_pred", "fwd_log_return"])
    return round_all(grid, ["fwd_log_return"], 9)


@query(
    "market_benchmark",
    f"WITH {OUTCOMES} SELECT round(exp(sum(fwd_log_return) / count(DISTINCT ticker)) - 1, 6) AS total_return_market FROM outcomes",
)
def market_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(pf.market_benchmark(fixtures.outcomes(spark, sf_dir)), ["total_return_market"])


@query("dense_dates", f"WITH {SIGNALS} SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM signals)")
def dense_date_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_dates(fixtures.signals(spark, sf_dir))


FOLD = {"train_days": 252, "step_days": 20, "embargo_days": 5}  # fixed values: production fold sizes

_FOLDS_SQL = f"""{OUTCOMES},
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM outcomes)),
folds AS (SELECT f AS fold, 257 + 20 * f AS test_from FROM range(0, greatest(0, ((SELECT count(*) FROM days) - 257 + 19) // 20)) r(f)),
assigned AS MATERIALIZED (
 SELECT fold, CASE WHEN i >= test_from THEN 'test' ELSE 'train' END AS role, o.*
 FROM outcomes o JOIN days USING (date) JOIN folds
   ON i BETWEEN test_from - 257 AND test_from - 6 OR i BETWEEN test_from AND test_from + 19)"""


@query(
    "fold_assign",
    f"WITH {_FOLDS_SQL} SELECT fold, role, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,"
    " round(avg(fwd_log_return), 9) AS mean_return FROM assigned GROUP BY fold, role",
)
def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fixtures.signals(spark, sf_dir).filter(F.col("fwd_log_return").isNotNull())
    assigned = lb.fold_assign(known.select("ticker", "date", "fwd_log_return"), **FOLD)
    return assigned.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.round(F.avg("fwd_log_return"), 9).alias("mean_return"),
    )


@query(
    "fold_thresholds",
    f"WITH {_FOLDS_SQL}, big AS (SELECT fold FROM assigned GROUP BY fold HAVING count_if(role = 'train') >= 100 AND count_if(role = 'test') >= 5)"
    " SELECT fold, round(quantile_cont(fwd_log_return, 0.66), 9) AS high, round(quantile_cont(fwd_log_return, 0.33), 9) AS low"
    " FROM assigned SEMI JOIN big USING (fold) WHERE role = 'train' GROUP BY fold",
)
def fold_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label thresholds of every usable fold, from one sketch per piece of a date step."""
    known = staged(fixtures.signals(spark, sf_dir).filter(F.col("fwd_log_return").isNotNull()).select("date", "fwd_log_return"))
    return round_all(lb.fold_thresholds(known, **FOLD), ["high", "low"], 9)


@query(
    "holdout_split",
    f"WITH {SIGNALS}, cut AS (SELECT min(date) AS c FROM (SELECT DISTINCT date FROM signals ORDER BY date DESC LIMIT 40))"
    " SELECT ticker, date, CASE WHEN date >= c THEN 'test' ELSE 'train' END AS split FROM signals, cut",
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.holdout_split(fixtures.signals(spark, sf_dir)).select("ticker", "date", "split")


@query(
    "density_guard",
    f"WITH {SIGNALS}, kept AS (SELECT * FROM signals WHERE date >= (SELECT max(date) FROM signals) - INTERVAL 1460 DAY)"
    " SELECT count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(*) >= 2000 AND count(DISTINCT date) >= 100 AS dense_enough FROM kept",
)
def density_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.density_report(lb.recent_years(fixtures.signals(spark, sf_dir)))


@query(
    "leave_one_ticker_out",
    f"WITH {OUTCOMES}, t AS (SELECT DISTINCT ticker AS holdout FROM outcomes)"
    " SELECT holdout, count_if(ticker = holdout)::BIGINT AS n_test, count_if(ticker <> holdout)::BIGINT AS n_train,"
    " round(avg(CASE WHEN ticker = holdout THEN fwd_log_return END), 9) AS mean_test,"
    " round(avg(CASE WHEN ticker <> holdout THEN fwd_log_return END), 9) AS mean_train FROM t, outcomes GROUP BY holdout",
)
def leave_one_ticker_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(lb.leave_one_out_summary(fixtures.outcomes(spark, sf_dir)), ["mean_test", "mean_train"], 9)


_CONVICTION_SQL = f"""CASE WHEN prob_buy >= {BUY_AT} THEN 'BUY' WHEN prob_sell >= {SELL_AT} THEN 'SELL' ELSE 'HOLD' END AS ml_decision,
 CASE WHEN prob_buy >= {BUY_AT} OR prob_sell >= {SELL_AT} THEN 'HOT'
  WHEN greatest(prob_buy, prob_sell) >= 0.38 AND greatest(prob_buy, prob_sell) < greatest({BUY_AT}, {SELL_AT}) THEN 'GREY' ELSE 'COLD' END AS conviction_zone,
 CASE WHEN prob_buy >= {BUY_AT} THEN 'BUY' WHEN prob_sell >= {SELL_AT} THEN 'SELL'
  WHEN greatest(prob_buy, prob_sell) >= 0.38 AND greatest(prob_buy, prob_sell) < greatest({BUY_AT}, {SELL_AT})
  THEN CASE WHEN prob_buy > prob_sell THEN 'BUY' ELSE 'SELL' END ELSE 'HOLD' END AS leaning_action,
 greatest(prob_buy, prob_sell) AS probability"""


@query("conviction", f"WITH {SIGNALS} SELECT ticker, date, {_CONVICTION_SQL} FROM signals")
def conviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = sg.conviction(F.col("prob_buy"), F.col("prob_sell"), fixtures.BUY_AT, fixtures.SELL_AT)
    return fixtures.signals(spark, sf_dir).select("ticker", "date", *[c.alias(n) for n, c in zones.items()])


@query(
    "metrics_table",
    f"WITH {DAILY}, m AS (SELECT {METRICS_SQL} FROM curve), a AS (SELECT avg((y_true = y_pred)::INT) AS acc FROM outcomes),"
    " l AS (SELECT ticker, avg((y_true = y_pred)::INT) AS acc FROM outcomes GROUP BY ticker),"
    " long AS (SELECT 'FIN_' || name AS key, value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME name VALUE value)"
    " UNION ALL SELECT 'ML_Accuracy_Global', acc FROM a UNION ALL SELECT 'LOO_acc_' || ticker, acc FROM l)"
    " SELECT 'walk_forward' AS run, key, round(value, 6) AS value FROM long",
)
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = staged(fixtures.outcomes(spark, sf_dir))
    run = "walk_forward"
    rows = (
        cl.metrics_table(run, pf.portfolio_metrics(results), "FIN_")
        .unionByName(cl.metrics_table(run, cl.accuracy(results, name="Accuracy_Global"), "ML_"))
        .unionByName(cl.keyed_metrics(run, cl.accuracy(results, ["ticker"]), "ticker", "accuracy", "LOO_acc_"))
    )
    rows, path = staged(rows), f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    for _ in range(2):  # a run that is logged again replaces its own rows
        files.append_metrics(rows, path)
    return round_all(files.read_metrics(spark, path), ["value"])

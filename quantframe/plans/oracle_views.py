"""Shared CTE texts of the DuckDB twins."""

from __future__ import annotations

TICKER_SQL = (
    "CASE {n} % 7 WHEN 0 THEN 'SPY' WHEN 1 THEN 'QQQ' WHEN 2 THEN 'DIA' WHEN 3 THEN 'GLD'"
    " WHEN 4 THEN 'TLT' WHEN 5 THEN 'IWM' ELSE 'VIX' END"
)

TRADES = f"""trades AS (
 SELECT {TICKER_SQL.format(n='c_nationkey')} AS ticker, l_extendedprice / l_quantity AS price, l_quantity AS qty,
   l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

BARS = f"""{TRADES},
ticks AS (
 SELECT ticker, price, qty, row_number() OVER (PARTITION BY ticker
   ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM trades),
bars AS MATERIALIZED (
 SELECT ticker, (rn + 1) // 2 AS bar_no, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low,
   arg_max(price, rn) AS close, sum(qty) AS volume,
   DATE '1995-01-01' + CAST((rn + 1) // 2 - 1 AS INTEGER) AS date
 FROM ticks GROUP BY ticker, (rn + 1) // 2)"""

BENCHMARK = """spy AS (
 SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS ret_spy_1d,
   ln(close / lag(close, 14) OVER (ORDER BY date)) AS ret_spy_14d FROM bars WHERE ticker = 'SPY'),
vix AS (
 SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS vix_return FROM bars WHERE ticker = 'VIX')"""

FEATURES = f"""{BARS},
{BENCHMARK},
f0 AS (
 SELECT b.*, ret_spy_1d, ret_spy_14d, vix_return,
   ln(close / lag(close, 1) OVER w) AS ret_1d, ln(close / lag(close, 3) OVER w) AS ret_3d,
   ln(close / lag(close, 5) OVER w) AS ret_5d, ln(close / lag(close, 10) OVER w) AS ret_10d,
   ln(close / lag(close, 14) OVER w) AS ret_14d, ln(close / lag(close, 20) OVER w) AS ret_20d,
   ln(lead(close) OVER w / close) AS fwd_log_return,
   coalesce(close - lag(close) OVER w, 0) AS delta,
   greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
   row_number() OVER w AS pos
 FROM bars b LEFT JOIN spy USING (date) LEFT JOIN vix USING (date) WHERE ticker <> 'VIX'
 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
f1 AS (
 SELECT *, ret_14d - ret_spy_14d AS rel_strength_14d,
   CASE WHEN ret_1d IS NOT NULL AND ret_spy_1d IS NOT NULL THEN ret_1d END AS rj,
   CASE WHEN ret_1d IS NOT NULL AND ret_spy_1d IS NOT NULL THEN ret_spy_1d END AS mj FROM f0),
f2 AS (
 SELECT *,
   CASE WHEN count(rj) OVER w20 = 20 THEN covar_samp(rj, mj) OVER w20 / (var_samp(ret_spy_1d) OVER w20 + 1e-8) END AS beta_20d,
   CASE WHEN count(rj) OVER w20 = 20 THEN covar_samp(rj, mj) OVER w20
     / nullif(stddev_samp(rj) OVER w20 * stddev_samp(mj) OVER w20, 0) END AS spy_corr_20d,
   CASE WHEN count(ret_1d) OVER w20 = 20 THEN stddev_samp(ret_1d) OVER w20 END AS vol_20d_std,
   CASE WHEN count(ret_1d) OVER w20 = 20 THEN (abs(ret_1d) - avg(abs(ret_1d)) OVER w20)
     / (stddev_samp(ret_1d) OVER w20 + 1e-8) END AS vol_shock_z,
   ret_1d - lag(ret_1d) OVER w AS price_accel_1d,
   ret_1d * vix_return AS vix_divergence,
   CASE WHEN pos >= 9 THEN avg(close) OVER w9 END AS sma9, CASE WHEN pos >= 20 THEN avg(close) OVER w20 END AS sma20,
   CASE WHEN pos >= 50 THEN avg(close) OVER w50 END AS sma50, CASE WHEN pos >= 200 THEN avg(close) OVER w200 END AS sma200,
   CASE WHEN pos >= 20 THEN 2 * stddev_samp(close) OVER w20 END AS dev20,
   CASE WHEN pos >= 9 THEN 100 - 100 / (1 + avg(greatest(delta, 0)) OVER w9 / (avg(greatest(-delta, 0)) OVER w9 + 1e-8)) END AS rsi_9,
   CASE WHEN pos >= 14 THEN 100 - 100 / (1 + avg(greatest(delta, 0)) OVER w14 / (avg(greatest(-delta, 0)) OVER w14 + 1e-8)) END AS rsi_14,
   CASE WHEN pos >= 21 THEN 100 - 100 / (1 + avg(greatest(delta, 0)) OVER w21 / (avg(greatest(-delta, 0)) OVER w21 + 1e-8)) END AS rsi_21,
   abs(open - close) / (high - low + 1e-8) AS candle_body,
   (high - greatest(open, close)) / (high - low + 1e-8) AS upper_shadow,
   (least(open, close) - low) / (high - low + 1e-8) AS lower_shadow,
   CASE WHEN pos >= 14 THEN avg(tr) OVER w14 / close END AS natr_14
 FROM f1 WINDOW w AS (PARTITION BY ticker ORDER BY date),
   w9 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW),
   w14 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
   w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
   w21 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
   w50 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
   w200 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
feats AS MATERIALIZED (
 SELECT *, (close - sma9) / sma9 AS dist_sma_9, (close - sma20) / sma20 AS dist_sma_20,
   (close - sma50) / sma50 AS dist_sma_50, (close - sma200) / sma200 AS dist_sma_200,
   sma50 / sma200 AS cross_sma_50_200,
   ((sma20 + dev20) - (sma20 - dev20)) / sma20 AS bb_width,
   (close - (sma20 - dev20)) / ((sma20 + dev20) - (sma20 - dev20) + 1e-8) AS bb_pct_b
 FROM f2)"""


def _recursive_means() -> str:
    """Step-by-step recursion y = b*y + a*x over bar numbers, all spans at once."""
    spans = (9, 12, 20, 26, 50, 200)
    first = ", ".join(f"close AS e{s}" for s in spans)
    step = ", ".join(
        f"p.e{s} * (1 - 2.0::DOUBLE / {s + 1}) + n.close * (2.0::DOUBLE / {s + 1}) AS e{s}" for s in spans
    )
    adjusted_first = ", ".join(f"close AS n{s}, 1.0::DOUBLE AS d{s}" for s in (9, 20))
    adjusted = ", ".join(
        f"p.n{s} * (1 - 2.0::DOUBLE / {s + 1}) + n.close AS n{s}, p.d{s} * (1 - 2.0::DOUBLE / {s + 1}) + 1 AS d{s}"
        for s in (9, 20)
    )
    e12 = "(p.e12 * (1 - 2.0::DOUBLE / 13) + n.close * (2.0::DOUBLE / 13))"
    e26 = "(p.e26 * (1 - 2.0::DOUBLE / 27) + n.close * (2.0::DOUBLE / 27))"
    return f"""emas AS (
 SELECT ticker, date, bar_no, close, {first}, {adjusted_first}, 0.0::DOUBLE AS sig
 FROM bars WHERE bar_no = 1 AND ticker <> 'VIX'
 UNION ALL
 SELECT n.ticker, n.date, n.bar_no, n.close, {step}, {adjusted}, p.sig * 0.8::DOUBLE + ({e12} - {e26}) * 0.2::DOUBLE
 FROM emas p JOIN bars n ON n.ticker = p.ticker AND n.bar_no = p.bar_no + 1)"""


EMAS = f"{BARS},\n{_recursive_means()}"
FEATURES_AND_EMAS = f"{FEATURES},\n{_recursive_means()}"


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)

BUY_AT, SELL_AT = "0.4418490104448511::DOUBLE", "0.5264213424699449::DOUBLE"
BULL, BEAR = "0.0053093753051493085::DOUBLE", "(-0.005749496635898443::DOUBLE)"

SIGNALS = f"""{BARS},
scored AS MATERIALIZED (
 SELECT ticker, date, bar_no, close, volume, ln(close / lag(close) OVER w) / 100 AS ret_1d,
   ln(lead(close) OVER w / close) / 100 AS fwd_log_return,
   volume / 125.0::DOUBLE AS prob_buy, (1 - volume / 125.0::DOUBLE) * low / high AS prob_sell
 FROM bars WHERE ticker <> 'VIX' WINDOW w AS (PARTITION BY ticker ORDER BY date)),
signals AS (
 SELECT *, CASE WHEN prob_sell >= {SELL_AT} THEN -1 WHEN prob_buy >= {BUY_AT} THEN 1 ELSE 0 END AS y_pred FROM scored)"""

OUTCOMES = f"""{SIGNALS},
limits AS (SELECT quantile_cont(fwd_log_return, 0.66) AS high, quantile_cont(fwd_log_return, 0.33) AS low FROM signals),
outcomes AS MATERIALIZED (
 SELECT s.*, CASE WHEN fwd_log_return > high THEN 1 WHEN fwd_log_return < low THEN -1 ELSE 0 END AS y_true
 FROM signals s, limits WHERE fwd_log_return IS NOT NULL)"""

DAILY = f"""{OUTCOMES},
daily AS (
 SELECT date, avg(fwd_log_return) AS market_return,
   avg(CASE y_pred WHEN 1 THEN fwd_log_return WHEN -1 THEN -fwd_log_return ELSE 0 END) AS strategy_return
 FROM outcomes GROUP BY date),
valued AS (SELECT *, exp(sum(strategy_return) OVER (ORDER BY date)) AS equity FROM daily),
curve AS (SELECT *, max(equity) OVER (ORDER BY date) AS running_max FROM valued)"""

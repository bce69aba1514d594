"""Queries over the price panel: bars, features, benchmark and macro joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe import fixtures
from quantframe.operators import features as ft
from quantframe.operators.ewm import ewm
from quantframe.plans.oracle_views import BARS, BENCHMARK, EMAS, FEATURES, FEATURES_AND_EMAS, rounded
from quantframe.plans.registry import query


def round_all(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _group_query(group: str, sql: str) -> None:
    columns = list(ft.GROUPS[group][1])

    @query(group, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = ft.feature_frame(fixtures.bars(spark, sf_dir), [group])
        return round_all(frame.select("ticker", "date", *columns), columns)


for _group, (_, _columns, _) in ft.GROUPS.items():
    if _group in ("dist_ema", "cross_ema", "macd"):
        continue
    _group_query(_group, f"WITH {FEATURES} SELECT ticker, date, {rounded(list(_columns))} FROM feats")

_EMA_SQL = {
    "dist_ema": ", ".join(f"round((close - e{n}) / e{n}, 6) AS dist_ema_{n}" for n in ft.AVERAGES),
    "cross_ema": "round((n9 / d9) / (n20 / d20), 6) AS cross_ema_9_20",
    "macd": "round((e12 - e26) - sig, 6) AS macd_hist",
}
for _group, _sql in _EMA_SQL.items():
    _group_query(_group, f"WITH RECURSIVE {EMAS} SELECT ticker, date, {_sql} FROM emas")


@query(
    "bars",
    f"WITH {BARS} SELECT ticker, date, bar_no, open, high, low, close, volume FROM bars",
)
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.bars(spark, sf_dir)


@query("vix_momentum", f"WITH {BARS}, {BENCHMARK} SELECT date, round(vix_return, 9) AS vix_return FROM vix")
def vix_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(ft.vix_momentum(fixtures.bars(spark, sf_dir)), ["vix_return"], 9)


@query(
    "benchmark_join",
    f"WITH {BARS}, {BENCHMARK} SELECT ticker, date, round(ret_spy_1d, 9) AS ret_spy_1d,"
    " round(ret_spy_14d, 9) AS ret_spy_14d FROM bars LEFT JOIN spy USING (date)",
)
def benchmark_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ft.benchmark_join(fixtures.bars(spark, sf_dir))
    return round_all(joined.select("ticker", "date", "ret_spy_1d", "ret_spy_14d"), ["ret_spy_1d", "ret_spy_14d"], 9)


@query(
    "macro_join",
    f"WITH {BARS}, {BENCHMARK} SELECT ticker, date, round(vix_return, 9) AS vix_return"
    " FROM bars LEFT JOIN vix USING (date) WHERE ticker <> 'VIX'",
)
def macro_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixtures.bars(spark, sf_dir)
    joined = ft.macro_join(bars.filter(F.col("ticker") != "VIX"), source=bars)
    return round_all(joined.select("ticker", "date", "vix_return"), ["vix_return"], 9)


@query(
    "ewm",
    f"WITH RECURSIVE {EMAS} SELECT ticker, date, round(n20 / d20, 6) AS ewm_adjusted, round(e20, 6) AS ewm_plain FROM emas",
)
def ewm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes of the exponentially weighted mean over twenty rows."""
    panel = fixtures.bars(spark, sf_dir).filter(F.col("ticker") != "VIX").select("ticker", "date", "bar_no", "close")
    both = ewm(panel, ["ticker"], "bar_no", "close", 20, adjust=True, name="ewm_adjusted")
    both = ewm(both, ["ticker"], "bar_no", "close", 20, adjust=False, name="ewm_plain")
    return round_all(both.select("ticker", "date", "ewm_adjusted", "ewm_plain"), ["ewm_adjusted", "ewm_plain"])


_EMA_COLUMNS = {
    **{f"dist_ema_{n}": f"(f.close - e{n}) / e{n}" for n in ft.AVERAGES},
    "cross_ema_9_20": "(n9 / d9) / (n20 / d20)",
    "macd_hist": "(e12 - e26) - sig",
}
_PANEL_COLUMNS = ", ".join(f"round({_EMA_COLUMNS.get(c, 'f.' + c)}, 6) AS {c}" for c in ft.FEATURES)
_PANEL_FROM = " FROM feats f JOIN emas e ON e.ticker = f.ticker AND e.bar_no = f.bar_no"
# the last inputs to become defined: sma200, joint 20-row returns, macro return, second difference
_COMPLETE = (
    " WHERE sma200 IS NOT NULL AND beta_20d IS NOT NULL AND spy_corr_20d IS NOT NULL AND vix_return IS NOT NULL"
    " AND rel_strength_14d IS NOT NULL AND price_accel_1d IS NOT NULL AND vol_shock_z IS NOT NULL"
)
PANEL_SQL = (
    f"WITH RECURSIVE {FEATURES_AND_EMAS} SELECT f.ticker, f.date, f.close, {_PANEL_COLUMNS},"
    f" round(fwd_log_return, 6) AS fwd_log_return{_PANEL_FROM}{_COMPLETE}"
)


@query("feature_panel", f"{PANEL_SQL} AND fwd_log_return IS NOT NULL")
def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = ft.feature_panel(fixtures.bars(spark, sf_dir))
    return round_all(panel, [*ft.FEATURES, "fwd_log_return"])


@query("drop_incomplete", PANEL_SQL)
def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = ft.feature_panel(fixtures.bars(spark, sf_dir), inference=True)
    return round_all(panel, [*ft.FEATURES, "fwd_log_return"])

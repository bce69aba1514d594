"""Portfolio returns, equity curves and position states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.operators.timeline import date_bucket, dense_dates, running
from quantframe.session import staged

YEAR_DAYS = 252
EPS = 1e-8


def signed_return(y_pred: Column, fwd: Column) -> Column:
    """Long earns the return, short its negative, flat nothing."""
    return F.when(y_pred == 1, fwd).when(y_pred == -1, -fwd).otherwise(F.lit(0.0))


def portfolio_daily(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-weight daily strategy and market return."""
    signed = signed_return(F.col("y_pred"), F.col("fwd_log_return"))
    return results.groupBy(*keys, "date").agg(
        F.avg("fwd_log_return").alias("market_return"), F.avg(signed).alias("strategy_return")
    )


def equity_curve(daily: DataFrame, keys: Sequence[str] = (), value: str = "strategy_return") -> DataFrame:
    """Cumulative value, its running maximum and the drawdown, per date.

    A bucket of dates is summed up by its total and its highest prefix.  Both carry over to the later buckets at once, so
    one window inside the buckets and one join with the small carries give sums and maxima together.
    """
    keys, zero = list(keys), F.lit(0.0)
    inside = Window.partitionBy(*keys, "_bk").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    local = daily.withColumn("_bk", date_bucket("date"))
    local = local.withColumn("_sum", F.coalesce(F.sum(value).over(inside), zero)).withColumn("_top", F.max("_sum").over(inside))
    local = staged(local)
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy(*keys, "_bk").agg(F.max_by("_sum", "date").alias("_s"), F.max("_top").alias("_t"))
    carry = totals.withColumn("_carry", F.coalesce(F.sum("_s").over(before), zero))
    carry = carry.withColumn("_high", F.max(F.col("_carry") + F.col("_t")).over(before)).select(*keys, "_bk", "_carry", "_high")
    valued = local.join(carry, [*keys, "_bk"]).withColumns(
        {"equity": F.exp(F.col("_carry") + F.col("_sum")), "running_max": F.exp(F.greatest("_high", F.col("_carry") + F.col("_top")))}
    )
    valued = valued.drop("_bk", "_sum", "_top", "_carry", "_high")
    return valued.withColumn("drawdown", F.try_divide(F.col("equity") - F.col("running_max"), F.col("running_max")))


def sharpe(mean: Column, std_pop: Column, risk_free: float = 0.0) -> Column:
    daily_rf = F.lit(risk_free / YEAR_DAYS)
    return F.sqrt(F.lit(float(YEAR_DAYS))) * (mean - daily_rf) / (std_pop + F.lit(EPS))


def portfolio_metrics(results: DataFrame, keys: Sequence[str] = (), risk_free: float = 0.0) -> DataFrame:
    """Total returns, maximum drawdown and Sharpe ratio, one row per key."""
    curve = equity_curve(portfolio_daily(results, keys), keys)
    return curve_metrics(curve, keys, risk_free)


def curve_metrics(curve: DataFrame, keys: Sequence[str] = (), risk_free: float = 0.0) -> DataFrame:
    return curve.groupBy(*keys).agg(
        (F.exp(F.sum("strategy_return")) - 1).alias("total_return_strat"),
        (F.exp(F.sum("market_return")) - 1).alias("total_return_market"),
        F.min("drawdown").alias("max_drawdown"),
        sharpe(F.avg("strategy_return"), F.stddev_pop("strategy_return"), risk_free).alias("sharpe_ratio"),
    )


def coverage(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows with a non-flat prediction."""
    return results.groupBy(*keys).agg(
        F.avg((F.col("y_pred") != 0).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_rows")
    )


# Fixed values of the trial score.
TOO_FEW_ROWS, TOO_FEW_SCORE = 100, -9999.0
MIN_COVERAGE, COVERAGE_WEIGHT = 0.20, 1000.0
MAX_DRAWDOWN, DRAWDOWN_PENALTY, LOSS_PENALTY = -0.20, 500.0, 200.0
RETURN_WEIGHT, SHARPE_WEIGHT = 100.0, 5.0


def tuning_score(results: DataFrame, trial: str = "trial") -> DataFrame:
    """Score of each trial from its out-of-sample rows."""
    joined = portfolio_metrics(results, [trial]).join(coverage(results, [trial]), trial)
    base = F.col("total_return_strat") * RETURN_WEIGHT + F.col("sharpe_ratio") * SHARPE_WEIGHT
    thin = F.when(F.col("coverage") < MIN_COVERAGE, (MIN_COVERAGE - F.col("coverage")) * COVERAGE_WEIGHT)
    deep = F.when(F.col("max_drawdown") < MAX_DRAWDOWN, DRAWDOWN_PENALTY)
    loss = F.when(F.col("total_return_strat") < 0, LOSS_PENALTY)
    zero = F.lit(0.0)
    score = base - F.coalesce(thin, zero) - F.coalesce(deep, zero) - F.coalesce(loss, zero)
    return joined.withColumn("score", F.when(F.col("n_rows") < TOO_FEW_ROWS, F.lit(TOO_FEW_SCORE)).otherwise(score))


#: Date indexes of the grid that one row of the expansion stands for.
GRID_DAYS = 1024


def date_ticker_grid(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Every (date, ticker) pair with the mean of each value, 0 where there is no row.

    The grid is the output, so each ticker is expanded over runs of the date index and meets the dates of
    a run by an equi-join: never a cross join.  The planner takes an expansion for as small as the tickers it
    comes from, and would collect it on the driver, so this join is told to shuffle.
    """
    days = dense_dates(df).select(F.col("date").alias("_d"), F.floor(F.col("date_idx") / F.lit(GRID_DAYS)).cast("long").alias("_run"))
    total = days.agg(F.count(F.lit(1))).scalar()
    runs = F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / F.lit(GRID_DAYS)).cast("long"))
    means = df.groupBy("date", "ticker").agg(*[F.avg(v).alias(v) for v in values])
    tickers = df.select("ticker").distinct().withColumn("_run", F.explode(runs))
    grid = days.join(tickers.hint("merge"), "_run").select(F.col("_d").alias("date"), "ticker")
    # for the same reason the grid's size is unknown: it is never the side that is sent
    return grid.join(means, ["date", "ticker"], "left").fillna(0.0, list(values))


def position_state(signals: DataFrame) -> DataFrame:
    """Long/cash state per row: long from a buy until the next sell, and the row's pnl."""
    decisive = F.when(F.col("y_pred") != 0, F.col("y_pred"))
    held = running(signals, ["ticker"], ["date"], date_bucket("date"), lasts={"_last": decisive})
    long = F.coalesce(F.col("_last") == 1, F.lit(False))
    return held.withColumns(
        {
            "state": long.cast("int"),
            "pnl": F.when(long, F.coalesce(F.col("fwd_log_return"), F.lit(0.0))).otherwise(F.lit(0.0)),
        }
    ).drop("_last")


def binary_portfolio(signals: DataFrame) -> DataFrame:
    """Daily equal-weight return of the long/cash book over all tickers, and of the market.

    A ticker without a row on a date keeps its state and earns nothing, so dividing the summed
    pnl by the number of tickers equals averaging a dense grid.
    """
    tickers = signals.select("ticker").distinct().agg(F.count(F.lit(1))).scalar()
    return (
        position_state(signals)
        .groupBy("date")
        .agg(F.sum("pnl").alias("_p"), F.sum("fwd_log_return").alias("_m"))
        .select(
            "date",
            (F.col("_p") / tickers).alias("strategy_return"),
            (F.coalesce(F.col("_m"), F.lit(0.0)) / tickers).alias("market_return"),
        )
    )


def market_benchmark(results: DataFrame) -> DataFrame:
    """Total return of holding every ticker equally, missing days earning nothing."""
    tickers = results.select("ticker").distinct().agg(F.count(F.lit(1))).scalar()
    return results.agg((F.exp(F.sum("fwd_log_return") / tickers) - 1).alias("total_return_market"))

"""Quantile labels and walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions.signals import label
from quantframe.operators.quantiles import exact_quantiles, piece_quantiles
from quantframe.operators.timeline import dense_dates
from quantframe.session import staged

# Default label quantiles and fold sizes.
Q_HIGH, Q_LOW = 0.66, 0.33
HOLDOUT_DATES = 40
MIN_DATES, MIN_ROWS = 100, 2000
MIN_TRAIN, MIN_TEST = 100, 5
KEEP_DAYS = 1460


def quantile_thresholds(
    df: DataFrame, keys: Sequence[str] = (), q_high: float = Q_HIGH, q_low: float = Q_LOW, value: str = "fwd_log_return"
) -> DataFrame:
    return exact_quantiles(df, keys, value, {"high": q_high, "low": q_low})


def label_by_quantiles(
    df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = (), inclusive: bool = False, name: str = "target"
) -> DataFrame:
    """Label rows with thresholds fitted elsewhere (per key, or one pair for all)."""
    value = F.col("fwd_log_return")
    if keys:
        joined = df.join(thresholds, list(keys))
        return joined.withColumn(name, label(value, F.col("high"), F.col("low"), inclusive)).drop("high", "low")
    limits = thresholds.select(F.struct("high", "low")).scalar()
    return df.withColumn(name, label(value, limits["high"], limits["low"], inclusive))


def fold_assign(
    df: DataFrame, train_days: int, step_days: int, embargo_days: int = 5, date: str = "date"
) -> DataFrame:
    """One row per (row, fold, role).

    Fold ``f`` trains on date indexes ``[f*step, f*step + train)`` and tests on ``step`` dates that
    start ``embargo`` dates later, so the folds of a row follow from its date index: no join with
    a fold table.
    """
    days = dense_dates(df, date).withColumnRenamed("date_idx", "_i")
    total = days.agg(F.count(F.lit(1))).scalar()
    first_test = train_days + embargo_days
    folds = F.greatest(F.ceil((total - F.lit(first_test)) / F.lit(step_days)), F.lit(0)).cast("long")
    i = F.col("_i")
    lowest = F.greatest(F.ceil((i - F.lit(train_days - 1)) / F.lit(step_days)), F.lit(0)).cast("long")
    highest = F.least(F.floor(i / F.lit(step_days)), F.col("_folds") - 1).cast("long")
    test_fold = F.floor((i - F.lit(first_test)) / F.lit(step_days)).cast("long")

    def entry(fold, role):
        return F.struct(fold.alias("fold"), F.lit(role).alias("role"))

    train = F.when(
        lowest <= highest, F.transform(F.sequence(lowest, highest), lambda f: entry(f, "train"))
    ).otherwise(F.array().cast("array<struct<fold:bigint,role:string>>"))
    test = F.when(
        (i >= first_test) & (test_fold < F.col("_folds")), F.array(entry(test_fold, "test"))
    ).otherwise(F.array().cast("array<struct<fold:bigint,role:string>>"))
    return (
        df.join(days.withColumn("_folds", folds), date)
        .withColumn("_f", F.explode(F.concat(train, test)))
        .withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")})
        .drop("_f", "_i", "_folds")
    )


def dense_folds(assigned: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Folds with enough train and test rows."""
    keys = list(keys)
    counts = assigned.groupBy(*keys).agg(
        F.count(F.when(F.col("role") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("role") == "test", 1)).alias("n_test"),
    )
    return counts.filter((F.col("n_train") >= MIN_TRAIN) & (F.col("n_test") >= MIN_TEST))


def _folds_between(i: Column, first: int, days: int, step_days: int, folds: Column) -> Column:
    """Numbers of the folds whose ``days`` dates from ``first`` dates after their start on hold date index ``i``."""
    lowest = F.greatest(F.ceil((i - F.lit(first + days - 1)) / F.lit(step_days)), F.lit(0)).cast("long")
    highest = F.least(F.floor((i - F.lit(first)) / F.lit(step_days)), folds - 1).cast("long")
    return F.when(lowest <= highest, F.sequence(lowest, highest)).otherwise(F.array().cast("array<bigint>"))


def fold_thresholds(
    df: DataFrame, train_days: int, step_days: int, embargo_days: int = 5, q_high: float = Q_HIGH, q_low: float = Q_LOW,
    value: str = "fwd_log_return", date: str = "date",
) -> DataFrame:
    """``fold, high, low``: label limits of every fold that ``dense_folds`` would keep, without a row per fold.

    A step of ``step_days`` dates is cut once, where the training span of an earlier fold ends inside it.  Each such piece
    has one sketch, and a fold's training span is a run of whole pieces; sizes come from counts per date.  ``df`` is
    read several times: stage it when it is costly.
    """
    days = staged(dense_dates(df, date).withColumnRenamed("date_idx", "_i"))
    total = days.count()
    folds = max(-(-(total - train_days - embargo_days) // step_days), 0)
    rest = train_days % step_days
    i = F.col("_i")
    step, part = F.floor(i / F.lit(step_days)).cast("long"), (F.pmod(i, F.lit(step_days)) >= rest).cast("int")
    per_day = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n")).join(days, date)

    def sizes(first: int, length: int, name: str) -> DataFrame:
        held = per_day.select("_n", F.explode(_folds_between(i, first, length, step_days, F.lit(folds))).alias("fold"))
        return held.groupBy("fold").agg(F.sum("_n").alias(name))

    train, test = sizes(0, train_days, "n_train"), sizes(train_days + embargo_days, step_days, "n_test")
    dense = train.join(test, "fold").filter((F.col("n_train") >= MIN_TRAIN) & (F.col("n_test") >= MIN_TEST)).select("fold")
    # the pieces of a fold: both parts of its whole steps and the first part of the step after them
    whole = train_days // step_days
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * whole - (rest == 0)).cast("long")))
    members = dense.withColumn("_at", at).select(
        "fold", (F.col("fold") + F.floor(F.col("_at") / 2)).cast("long").alias("_step"), F.pmod("_at", F.lit(2)).cast("int").alias("_part")
    )
    pieces = staged(df.join(days, date).select(step.alias("_step"), part.alias("_part"), F.col(value).alias("_value")))
    return piece_quantiles(pieces, ["_step", "_part"], members, ["fold"], "_value", {"high": q_high, "low": q_low})


def density_report(df: DataFrame, date: str = "date") -> DataFrame:
    """Row and date counts of a training set against the minimum sizes."""
    sizes = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(date).alias("n_dates"))
    return sizes.withColumn("dense_enough", (F.col("n_rows") >= MIN_ROWS) & (F.col("n_dates") >= MIN_DATES))


def density_guard(df: DataFrame, min_rows: int = MIN_ROWS, min_dates: int = MIN_DATES, date: str = "date") -> DataFrame:
    """Pass through, failing the job when the training set is too thin."""
    sizes = df.agg(F.count(F.lit(1)).alias("r"), F.count_distinct(date).alias("d"))
    verdict = sizes.select(
        F.when((F.col("r") < min_rows) | (F.col("d") < min_dates), F.raise_error(F.concat(
            F.lit("insufficient data density: "), F.col("r"), F.lit(" rows, "), F.col("d"), F.lit(" dates")
        )).cast("boolean")).otherwise(F.lit(True))
    )
    return df.filter(verdict.scalar())


def recent_years(df: DataFrame, days: int = KEEP_DAYS, date: str = "date") -> DataFrame:
    """Rows within ``days`` calendar days of the latest date."""
    newest = df.agg(F.max(date)).scalar()
    return df.filter(F.col(date) >= F.date_sub(newest, days))


def holdout_split(df: DataFrame, dates: int = HOLDOUT_DATES, date: str = "date") -> DataFrame:
    """Mark the last ``dates`` distinct dates as test, everything earlier as train."""
    last = df.select(date).distinct().orderBy(F.col(date).desc()).limit(dates)
    cutoff = last.agg(F.min(date)).scalar()
    return df.withColumn("split", F.when(F.col(date) >= cutoff, "test").otherwise("train"))


def leave_one_ticker_out(df: DataFrame, holdout: str) -> DataFrame:
    """Mark the held-out ticker's own rows as test, all others as train."""
    return df.withColumn("role", F.when(F.col("ticker") == holdout, "test").otherwise("train"))


def leave_one_out_summary(df: DataFrame, value: str = "fwd_log_return") -> DataFrame:
    """Row counts and mean return of both sides of every hold-out.

    The train side of a ticker is everything minus its own part, so no row is copied per ticker.
    """
    own = df.groupBy("ticker").agg(F.count(value).alias("n_test"), F.sum(value).alias("_s"))
    whole = own.agg(F.sum("n_test").alias("n"), F.sum("_s").alias("s"))
    both = whole.select(F.struct("n", "s")).scalar()
    rows, total = both["n"], both["s"]
    return own.select(
        F.col("ticker").alias("holdout"),
        "n_test",
        (rows - F.col("n_test")).alias("n_train"),
        F.try_divide(F.col("_s"), F.col("n_test")).alias("mean_test"),
        F.try_divide(total - F.col("_s"), rows - F.col("n_test")).alias("mean_train"),
    )

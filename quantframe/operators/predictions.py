"""Reconciliation of past predictions and drift checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions.signals import action_name, label
from quantframe.operators.tables import upsert
from quantframe.operators.timeline import date_bucket, running

# Fixed values of the drift check.
DRIFT_SAMPLE, DRIFT_WIN_RATE = 20, 0.45


def next_close_asof(predictions: DataFrame, bars: DataFrame, target: Column) -> DataFrame:
    """First close strictly after each prediction's signal date and not after ``target``.

    Both inputs are merged into one series per ticker and walked from the last date to the
    first; the most recent bar seen before a prediction is its next close.  Linear, no range join.
    """
    rest = [c for c in predictions.columns if c != "ticker"]
    left = predictions.select(
        "ticker", F.col("signal_date").alias("_d"), F.lit(1).alias("_kind"),
        F.struct(*rest).alias("_row"), F.lit(None).cast("double").alias("_close"),
    )
    right = bars.filter(F.col("date") <= target).select(
        "ticker", F.col("date").alias("_d"), F.lit(0).alias("_kind"),
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("close").alias("_close"),
    )
    seen = F.when(F.col("_kind") == 0, F.struct(F.col("_d").alias("date"), F.col("_close").alias("close")))
    walked = running(
        left.unionByName(right), ["ticker"], ["_d", "_kind"], date_bucket("_d"), lasts={"_next": seen}, descending=True
    )
    return walked.filter(F.col("_kind") == 1).select(
        "ticker", "_row.*", F.col("_next.date").alias("next_date"), F.col("_next.close").alias("next_close")
    )


def pending(predictions: DataFrame, target: Column) -> DataFrame:
    return predictions.filter((F.col("prediction_date") < target) & (F.col("reconciliation_status") == "PENDING"))


def reconcile(predictions: DataFrame, bars: DataFrame, target: Column, bull: float, bear: float) -> DataFrame:
    """Pending predictions with a later close: realised return, true label, hit and trade return."""
    matched = next_close_asof(pending(predictions, target), bars, target).filter(F.col("next_close").isNotNull())
    gain = F.ln(F.try_divide(F.col("next_close"), F.col("pred_close_price")))
    acted = F.col("llm_verdict").isin("BUY", "SELL")
    return (
        matched.withColumn("realized_return", gain)
        .withColumn("actual_close_price", F.col("next_close"))
        .withColumn("true_label", action_name(label(F.col("realized_return"), bull, bear, inclusive=True)))
        .withColumn("hit", F.when(acted, (F.col("llm_verdict") == F.col("true_label")).cast("int")))
        .withColumn(
            "trade_return",
            F.when(F.col("llm_verdict") == "BUY", F.col("realized_return")).when(
                F.col("llm_verdict") == "SELL", -F.col("realized_return")
            ),
        )
        .withColumn("reconciliation_status", F.lit("RECONCILED"))
        .drop("next_date", "next_close")
    )


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """Win rate, mean return and volume of the acted-on predictions, and the count of all."""
    return reconciled.agg(
        F.avg(F.col("hit").cast("double")).alias("win_rate"),
        F.avg("trade_return").alias("avg_return"),
        F.count("hit").alias("volume"),
        F.count(F.lit(1)).alias("reconciled"),
    )


def apply_reconciliation(predictions: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Prediction table with the reconciled rows written over."""
    return upsert(predictions, reconciled.select(*predictions.columns), ["ticker", "signal_date"])


def recent_reconciled(predictions: DataFrame, target: Column, n: int = DRIFT_SAMPLE) -> DataFrame:
    """The last ``n`` reconciled non-HOLD predictions."""
    usable = predictions.filter(
        (F.col("quant_decision") != "HOLD")
        & (F.col("reconciliation_status") == "RECONCILED")
        & (F.col("prediction_date") <= target)
    )
    return usable.orderBy(F.col("prediction_date").desc(), F.col("id").desc()).limit(n)


def drift_check(predictions: DataFrame, target: Column, n: int = DRIFT_SAMPLE) -> DataFrame:
    """One row: sample size, win rate by the sign of the return, and the status."""
    won = ((F.col("quant_decision") == "BUY") & (F.col("realized_return") > 0)) | (
        (F.col("quant_decision") == "SELL") & (F.col("realized_return") < 0)
    )
    rated = recent_reconciled(predictions, target, n).agg(
        F.count(F.lit(1)).alias("sample"), F.avg(won.cast("double")).alias("win_rate")
    )
    status = (
        F.when(F.col("sample") < n, "insufficient")
        .when(F.col("win_rate") >= DRIFT_WIN_RATE, "healthy")
        .otherwise("drift")
    )
    return rated.withColumn("status", status)

"""Scheduled jobs: daily inference, light and heavy retraining, production export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.functions import signals as sg
from quantframe.ml import models
from quantframe.ml.validation import FoldPlan, param_search, trial_plan
from quantframe.operators import features as ft
from quantframe.operators import labels as lb
from quantframe.operators import portfolio as pf
from quantframe.operators.bars import lookback_scan
from quantframe.operators.classification import actionable_accuracy
from quantframe.operators.news import news_context
from quantframe.operators.predictions import drift_check
from quantframe.operators.retrieval import knn_filtered
from quantframe.operators.tables import upsert
from quantframe.session import staged
from quantframe.sources.files import load_manifest, manifest_frame, write_manifest

# Calendar days each job looks back.
INFERENCE_DAYS, LIGHT_DAYS, HEAVY_DAYS = 300, 540, 1760


@dataclass
class Champion:
    """A model with the rules it is used under."""

    model: PipelineModel
    buy_at: float
    sell_at: float
    bull_limit: float
    bear_limit: float

    @property
    def features(self) -> list[str]:
        return models.feature_names(self.model)


def champion_challenger(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """One row from two actionable-accuracy frames: promote only a strictly better challenger."""
    old = champion.select("actionable_accuracy").scalar()
    return challenger.select(
        old.alias("champion_accuracy"),
        F.col("actionable_accuracy").alias("challenger_accuracy"),
        (F.col("actionable_accuracy") > old).alias("promoted"),
    )


def _rated(entry: Champion, rows: DataFrame) -> DataFrame:
    """Actionable accuracy; the rows carry the label set to score against as ``y_true``."""
    scored = models.score_probabilities(entry.model, rows)
    return actionable_accuracy(scored, entry.buy_at, entry.sell_at, priority="buy")


def export_model(champion: Champion, path: str, details: Mapping[str, object] | None = None) -> None:
    """Model and manifest side by side."""
    champion.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    values = {
        "buy_threshold": champion.buy_at,
        "sell_threshold": champion.sell_at,
        "bull_limit": champion.bull_limit,
        "bear_limit": champion.bear_limit,
        "req_features": champion.features,
        **(details or {}),
    }
    write_manifest(manifest_frame(spark, values), f"{path}/manifest")


def load_champion(spark: SparkSession, path: str) -> Champion:
    rules = load_manifest(spark, f"{path}/manifest").first()
    model = PipelineModel.load(f"{path}/model")
    return Champion(model, rules.buy_threshold, rules.sell_threshold, rules.bull_limit, rules.bear_limit)


def light_retrain(
    bars: DataFrame, predictions: DataFrame, champion: Champion, day: Column, model_params: Mapping[str, object],
    class_weight: Mapping[int, float] | None = None, min_dates: int = lb.MIN_DATES,
) -> tuple[DataFrame, PipelineModel | None]:
    """Refit the champion's rules on recent data when drift is confirmed.

    Returns a one-row report and, if promoted, the model refitted on all rows.
    """
    status = drift_check(predictions, day).first()["status"]
    spark = bars.sparkSession
    schema = "status string, champion_accuracy double, challenger_accuracy double, promoted boolean"
    if status != "drift":
        return spark.createDataFrame([(status, None, None, False)], schema), None
    panel = ft.feature_panel(_renumbered(lookback_scan(bars, day, LIGHT_DAYS)))
    target = sg.label(F.col("fwd_log_return"), champion.bull_limit, champion.bear_limit, inclusive=True)
    rows = staged(lb.holdout_split(panel).withColumns({"target": target, "y_true": target}))
    lb.density_guard(rows, min_rows=0, min_dates=min_dates).limit(1).count()
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    fit = lambda df: models.train_classifier(df, champion.features, class_weight=class_weight, **model_params)
    challenger = Champion(fit(train), champion.buy_at, champion.sell_at, champion.bull_limit, champion.bear_limit)
    verdict = staged(champion_challenger(_rated(champion, test), _rated(challenger, test)))
    report = verdict.select(F.lit(status).alias("status"), "*")
    return report, fit(rows) if verdict.first()["promoted"] else None


def heavy_retrain(
    bars: DataFrame, champion: Champion, day: Column, base: FoldPlan, n_trials: int = 40, n_features: int = 15,
    export_to: str | None = None, min_rows: int = lb.MIN_ROWS, search_space: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """Full search: density check, feature selection, trials, challenge, export of a winner."""
    panel = ft.feature_panel(_renumbered(lookback_scan(bars, day, HEAVY_DAYS)))
    recent = panel.filter(F.col("date") >= F.date_sub(day, lb.KEEP_DAYS))
    rows = staged(lb.holdout_split(recent))
    lb.density_guard(rows, min_rows=min_rows, min_dates=0).limit(1).count()
    train, test = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")
    labelled = lb.label_by_quantiles(train, lb.quantile_thresholds(train))
    chosen = models.top_features(labelled, ft.FEATURES, n_features)
    extra = {"space": search_space} if search_space else {}
    _, best = param_search(train, ft.FEATURES, base, n_trials, **extra)
    plan = trial_plan(base, best)

    limits = lb.quantile_thresholds(train, (), plan.q_high, plan.q_low).first()
    challenger_label = sg.label(F.col("fwd_log_return"), limits["high"], limits["low"])
    fit = lambda df, y: models.train_classifier(
        df.withColumn("target", y), chosen, class_weight=plan.class_weight, **plan.model
    )
    challenger = Champion(fit(train, challenger_label), plan.buy_at, plan.sell_at, limits["high"], limits["low"])
    # each side is scored against the labels of its own rules
    champion_label = sg.label(F.col("fwd_log_return"), champion.bull_limit, champion.bear_limit, inclusive=True)
    verdict = staged(
        champion_challenger(
            _rated(champion, test.withColumn("y_true", champion_label)),
            _rated(challenger, test.withColumn("y_true", challenger_label)),
        )
    )
    if export_to is not None and verdict.first()["promoted"]:
        final = lb.quantile_thresholds(rows, (), plan.q_high, plan.q_low).first()
        label = sg.label(F.col("fwd_log_return"), final["high"], final["low"])
        winner = Champion(fit(rows, label), plan.buy_at, plan.sell_at, final["high"], final["low"])
        details = {
            "q_high_original": plan.q_high,
            "q_low_original": plan.q_low,
            "req_train_days": plan.train_days,
            "req_step_days": plan.step_days,
            "req_embargo_days": plan.embargo_days,
            "class_weight": {str(k): float(v) for k, v in plan.class_weight.items()},
            "model_params": {k: float(v) for k, v in plan.model.items() if k != "kind"},
        }
        export_model(winner, export_to, details)
    return verdict.withColumn("features", F.lit(",".join(chosen)))


def _renumbered(bars: DataFrame) -> DataFrame:
    """A slice of a series starts its positions anew, as its own first bar seeds the averages."""
    return ft.number_bars(bars.drop("bar_no"))


def score_signals(cross_section: DataFrame, champion: Champion) -> DataFrame:
    """Quant signals of a cross-section with their three strongest drivers."""
    names = champion.features
    guarded = staged(ft.null_guard(cross_section, names))
    zones = sg.conviction(F.col("prob_buy"), F.col("prob_sell"), champion.buy_at, champion.sell_at)
    signals = models.score_probabilities(champion.model, guarded).withColumns(zones)
    parts = models.occlusion(champion.model, guarded, ["ticker"], (models.BUY, models.SELL))
    action = F.when(F.col("class_index") == models.BUY, "BUY").otherwise("SELL").alias("_class")
    ranked = F.sort_array(F.collect_list(F.struct((-F.abs("contribution")).alias("size"), "feature")))
    drivers = parts.groupBy("ticker", action).agg(F.transform(F.slice(ranked, 1, 3), lambda r: r["feature"]).alias("top_drivers"))
    explained = signals.join(
        drivers.withColumnsRenamed({"_class": "leaning_action"}), ["ticker", "leaning_action"], "left"
    )
    none = F.array(F.lit("None"))
    return explained.withColumn(
        "top_drivers", F.when(F.col("conviction_zone") == "COLD", none).otherwise(F.col("top_drivers"))
    )


def daily_inference(
    bars: DataFrame, predictions: DataFrame, champion: Champion, queries: DataFrame, corpus: DataFrame,
    answers: DataFrame, day: Column, day_epoch: float,
) -> DataFrame:
    """Prediction table after the day's run: features, scores, news, verdicts, upsert."""
    window = _renumbered(lookback_scan(bars, day, INFERENCE_DAYS))
    latest = ft.latest_cross_section(staged(ft.feature_panel(window, inference=True)))
    signals = staged(score_signals(latest, champion))
    warm = signals.filter(F.col("conviction_zone") != "COLD").select("ticker")
    matches = knn_filtered(queries.join(warm, "ticker", "left_semi"), corpus, day_epoch)
    informed = news_context(signals, matches, day_epoch)
    decided = informed.join(answers, "ticker", "left").withColumn(
        "llm_verdict",
        sg.verdict(F.col("conviction_zone"), F.col("has_news"), F.col("leaning_action"), F.col("answer")),
    )
    rows = decided.select(
        F.concat_ws("#", "ticker", F.col("date").cast("string")).alias("id"),
        F.date_add("date", 1).alias("prediction_date"), F.col("date").alias("signal_date"), "ticker",
        F.col("ml_decision").alias("quant_decision"), F.col("probability").alias("quant_probability"),
        "conviction_zone", F.concat_ws(",", "top_drivers").alias("top_drivers"),
        F.col("close").alias("pred_close_price"), "llm_verdict",
        F.lit(None).cast("double").alias("actual_close_price"), F.lit(None).cast("double").alias("realized_return"),
        F.lit("PENDING").alias("reconciliation_status"),
    )
    return upsert(predictions, rows, ["signal_date", "ticker"])


def oos_portfolio(panel: DataFrame, champion: Champion) -> DataFrame:
    """Metrics of the long/cash book the champion would have run over an unseen panel."""
    scored = models.score_probabilities(champion.model, panel)
    called = sg.decide(F.col("prob_buy"), F.col("prob_sell"), champion.buy_at, champion.sell_at, "sell")
    rows = staged(scored.select("ticker", "date", "fwd_log_return", called.alias("y_pred")))
    return pf.curve_metrics(pf.equity_curve(pf.binary_portfolio(rows)))

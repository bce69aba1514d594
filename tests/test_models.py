"""Models and validation on a small panel whose return follows one feature."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe.ml import jobs, models
from quantframe.ml import validation as vd

FEATURES = ["signal", "noise"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    n = 120
    parts = []
    for ticker in ("A", "B", "C"):
        signal = rng.normal(size=n)
        dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
        parts.append(pd.DataFrame(dict(ticker=ticker, date=dates, signal=signal, noise=rng.normal(size=n), fwd_log_return=signal / 100)))
    return spark.createDataFrame(pd.concat(parts)).withColumn("date", F.col("date").cast("date")).cache()


PLAN = vd.FoldPlan(train_days=60, step_days=30, embargo_days=5, n_features=1, buy_at=0.5, sell_at=0.5, model={"numTrees": 5, "maxDepth": 3})


def test_walk_forward_learns_the_signal_on_later_dates(panel):
    rows, model = vd.walk_forward(panel, FEATURES, PLAN)
    pdf = rows.toPandas()
    assert models.feature_names(model) == ["signal"]
    first = dt.date(2020, 1, 1) + dt.timedelta(days=65)
    assert pdf["date"].min() == first and len(pdf) == 3 * (120 - 65) and set(pdf["fold"]) == {0, 1}
    assert (pdf["y_true"] == pdf["y_pred"]).mean() > 0.8


def test_shuffled_targets_keep_their_counts_but_not_their_rows(panel):
    rows = panel.withColumn("target", F.when(F.col("signal") > 0, 1).otherwise(-1))
    shuffled = vd._shuffled(rows, 1).toPandas().set_index(["ticker", "date"])["target"].sort_index()
    original = rows.toPandas().set_index(["ticker", "date"])["target"].sort_index()
    assert shuffled.value_counts().to_dict() == original.value_counts().to_dict()
    assert 0.3 < (shuffled == original).mean() < 0.7


def test_held_out_ticker_is_predicted_from_the_others(panel):
    rated = {r.holdout: r.accuracy for r in vd.leave_one_out_accuracy(panel, FEATURES, PLAN, ["B"]).collect()}
    assert rated.keys() == {"B"} and rated["B"] > 0.7


def test_occlusion_blames_the_used_feature(panel):
    rows = panel.withColumn("target", F.when(F.col("signal") > 0.4, 1).when(F.col("signal") < -0.4, -1).otherwise(0))
    model = models.train_classifier(rows, FEATURES, numTrees=5, maxDepth=3)
    impact = models.attribution_mean_abs(models.occlusion(model, panel, ["ticker", "date"])).collect()
    assert [r.feature for r in impact] == ["signal", "noise"]


def test_trials_are_seeded_and_stay_in_range():
    trials = vd.draw_trials(20, seed=3)
    assert trials == vd.draw_trials(20, seed=3) != vd.draw_trials(20, seed=4)
    for trial in trials:
        for name, (low, high) in vd.SEARCH_SPACE.items():
            assert low <= trial[name] <= high and isinstance(trial[name], type(low))


def test_only_a_strictly_better_challenger_is_promoted(spark):
    frame = lambda x: spark.createDataFrame([(x,)], "actionable_accuracy double")
    verdict = lambda a, b: jobs.champion_challenger(frame(a), frame(b)).first()["promoted"]
    assert (verdict(0.5, 0.5), verdict(0.5, 0.6), verdict(0.6, 0.5)) == (False, True, False)


def test_light_retrain_stops_without_drift(spark):
    rows = [(str(i), dt.date(2024, 1, 1), "BUY", "RECONCILED", 1.0) for i in range(20)]
    table = spark.createDataFrame(rows, "id string, prediction_date date, quant_decision string, reconciliation_status string, realized_return double")
    bars = spark.createDataFrame([], "ticker string, date date, close double")
    champion = jobs.Champion(None, 0.5, 0.5, 0.0, 0.0)
    report, model = jobs.light_retrain(bars, table, champion, F.lit(dt.date(2024, 1, 2)), {})
    assert report.first()["status"] == "healthy" and model is None


def test_exported_champion_scores_the_same(spark, panel, tmp_path):
    rows = panel.withColumn("target", F.when(F.col("signal") > 0, 1).otherwise(-1))
    champion = jobs.Champion(models.train_classifier(rows, FEATURES, numTrees=3), 0.4, 0.6, 0.01, -0.02)
    jobs.export_model(champion, str(tmp_path), {"class_weight": {"-1": 1.5}})
    loaded = jobs.load_champion(spark, str(tmp_path))
    assert (loaded.buy_at, loaded.sell_at, loaded.bull_limit, loaded.bear_limit) == (0.4, 0.6, 0.01, -0.02)
    scores = [models.score_probabilities(c.model, panel).agg(F.sum("prob_buy")).first()[0] for c in (champion, loaded)]
    assert scores[0] == pytest.approx(scores[1])


def test_boosted_trees_beat_a_forest_of_the_same_depth(spark, tmp_path):
    """A class that needs a sum of steps: shallow trees add up when boosted, and only then."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (1500, 4))
    total = x.sum(axis=1)
    target = np.where(total > 0.6, 1, np.where(total < -0.6, -1, 0))
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(target=target, n=range(1500)))
    fit = lambda kind, **options: models.train_classifier(rows.where("n < 1000"), names, kind=kind, maxDepth=1, **options)
    hits = {}
    for kind, options in (("forest", {"numTrees": 25}), ("boosted", {"maxIter": 25, "stepSize": 0.3})):
        model = fit(kind, **options)
        rated = models.predicted_class(model, rows.where("n >= 1000")).select((F.col("y_pred") == F.col("target")).cast("double").alias("hit"))
        hits[kind] = rated.agg(F.avg("hit")).first()[0]
    assert hits["boosted"] > hits["forest"] + 0.1
    scored = models.score_probabilities(model, rows)
    assert scored.where("prob_buy < 0 or prob_sell < 0 or prob_buy + prob_sell > 1.000001").isEmpty()
    assert [n for n, v in models.feature_importance(model) if v > 0.1] and sum(v for _, v in models.feature_importance(model)) == pytest.approx(1, abs=0.01)
    jobs.export_model(jobs.Champion(model, 0.4, 0.4, 0.1, -0.1), str(tmp_path / "m"))
    again = models.score_probabilities(jobs.load_champion(spark, str(tmp_path / "m")).model, rows)
    assert again.select(F.round(F.sum("prob_buy"), 6)).first() == scored.select(F.round(F.sum("prob_buy"), 6)).first()


def test_search_parameters_all_act():
    trial = vd.draw_trials(1, seed=3)[0]
    boosted, forest = vd.trial_model(trial, "boosted"), vd.trial_model(trial, "forest")
    assert boosted["stepSize"] == trial["learning_rate"] and boosted["maxIter"] == forest["numTrees"] == trial["n_estimators"]
    assert 2 ** boosted["maxDepth"] <= max(trial["num_leaves"], 2) and boosted["maxDepth"] <= trial["max_depth"]


def test_occlusion_scores_all_classes_at_once(panel):
    rows = panel.withColumn("target", F.when(F.col("signal") > 0.4, 1).when(F.col("signal") < -0.4, -1).otherwise(0))
    model = models.train_classifier(rows, FEATURES, numTrees=5, maxDepth=3)
    both = {tuple(r)[:4]: r.contribution for r in models.occlusion(model, panel, ["ticker", "date"], (models.BUY, models.SELL)).collect()}
    one = models.occlusion(model, panel, ["ticker", "date"], (models.BUY,)).collect()
    assert len(both) == 2 * len(one) == 4 * panel.count()
    assert all(both[tuple(r)[:4]] == pytest.approx(r.contribution) for r in one)


def test_permutations_share_one_stored_panel(panel, monkeypatch):
    indexed = vd.index_panel(panel)

    def again(_):
        raise AssertionError("the panel is stored a second time")

    monkeypatch.setattr(vd, "index_panel", again)
    assert vd.permutation_test(indexed, FEATURES, PLAN, 0.9, iterations=1).first()["iterations"] == 1

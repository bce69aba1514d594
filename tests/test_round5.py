"""What the fifth round changed: whole parameters of model queries, and what lies on disk while they run."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from quantframe.ml import models
from quantframe.ml import validation as vd
from quantframe.operators import features as ft
from quantframe.plans import market_queries as kq
from quantframe.plans import model_queries as mq
from quantframe.session import _stage_root, staged
from quantframe.sources import files


class Seen(Exception):
    """Ends a query once the call under test was met."""


def _called_with(monkeypatch, module, name, run):
    """Arguments of the first call of a function inside ``run``."""

    def seen(*args, **options):
        raise Seen(args, options)

    monkeypatch.setattr(module, name, seen)
    with pytest.raises(Seen) as caught:
        run()
    return caught.value.args


def test_boosted_query_fits_the_production_rounds(spark, sf_dir, monkeypatch):
    _, options = _called_with(monkeypatch, models, "train_classifier", lambda: mq.train_boosted(spark, sf_dir))
    assert options["kind"] == "boosted" and options["maxIter"] == 171 and options["minInstancesPerNode"] == 78
    assert options["maxDepth"] == 4 and options["stepSize"] == pytest.approx(0.0584546)


def test_search_query_keeps_every_trial_and_the_whole_space(spark, sf_dir, monkeypatch):
    (panel, features, plan, *rest), options = _called_with(monkeypatch, vd, "param_search", lambda: mq.param_search(spark, sf_dir))
    assert not rest and not options  # all trials of the default, over the default space
    dates = panel.select("date").distinct().count()
    assert dates < 257 and plan.train_days == dates // 2  # the smallest set has no production fold
    assert (plan.step_days, plan.embargo_days, plan.n_features) == (20, 5, 15) and len(features) == 34


def test_search_folds_are_the_production_ones_where_the_history_allows(spark):
    plan = mq._search_plan(spark.sql("select date_add(date'2020-01-01', cast(id as int)) as date from range(258)"))
    assert (plan.train_days, plan.step_days, plan.embargo_days) == (252, 20, 5)


def _shuffle_files(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum("shuffle_" in str(name) for name in blocks.getAllBlocks().mkString("\n").split("\n"))


def test_a_written_frame_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    given = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    frame = staged(spark.range(1000).repartition(4, "id"))
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before and frame.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == given


def _stored_frames(spark) -> int:
    return sum("_SUCCESS" in names for _, _, names in os.walk(_stage_root(spark).removeprefix("file:")))


def test_the_panel_is_all_that_its_making_leaves(spark, sf_dir):
    before = _stored_frames(spark)
    panel = mq._panel(spark, sf_dir)
    assert _stored_frames(spark) == before + 1 and panel.count() == 863


def test_labels_are_no_second_copy_of_the_panel(spark, sf_dir):
    panel = mq._panel(spark, sf_dir)
    before = {f.rsplit("/", 1)[0] for f in panel.inputFiles()}
    rows = mq._labelled(panel)
    assert {f.rsplit("/", 1)[0] for f in rows.select("ret_1d").inputFiles()} == before
    assert {r[0] for r in rows.select("target").distinct().collect()} == {-1, 0, 1}


def test_latest_rows_come_from_one_pass_that_stores_no_panel(spark, sf_dir):
    rows = [("A", "2024-01-01", 1), ("A", None, 2), ("B", "2024-01-03", 3), ("B", "2024-01-03", 3), ("C", "2024-01-02", None), ("D", "2024-01-03", None)]
    frame = spark.createDataFrame(rows, "ticker string, date string, x int").withColumn("date", F.col("date").cast("date")).repartition(3)
    found = sorted((r.ticker, r.x) for r in ft.latest_cross_section(frame).collect() if r.x) + [r.ticker for r in ft.latest_cross_section(frame).where("x is null").collect()]
    assert found == [("B", 3), ("B", 3), "D"]
    before = _stored_frames(spark)
    latest = kq.latest_cross_section(spark, sf_dir)
    assert _stored_frames(spark) == before + 1 and latest.count() == sum(spark.read.parquet(f).count() for f in latest.inputFiles())


def test_reports_are_replaced_in_turns(spark, tmp_path, monkeypatch):
    days = [dt.date(2020 + i, 1, 1) for i in range(9)]
    rows = lambda text: staged(spark.createDataFrame([(t, d, text) for t in ("SPY", "QQQ") for d in days], "ticker string, date date, report string"))
    written = []
    real = files.shuffles_dropped
    monkeypatch.setattr(files, "WRITTEN_AT_ONCE", 0)
    monkeypatch.setattr(files, "shuffles_dropped", lambda s: written.append(1) or real(s))
    for text in ("old", "new"):
        files.write_reports(rows(text), str(tmp_path / "r"), "yyyy")
    back = [tuple(r) for r in files.read_reports(spark, str(tmp_path / "r")).collect()]
    assert sorted(back) == sorted((t, d, "new") for t in ("SPY", "QQQ") for d in days) and len(written) == 2 * files.TURNS


@pytest.fixture(scope="module")
def small_panel(spark):
    start = "date_add(date'2020-01-01', cast(id div 3 as int))"
    return staged(spark.range(300).selectExpr("concat('T', id % 3) as ticker", f"{start} as date", "sin(id) as a", "sin(id * 7) as fwd_log_return").where("id % 11 > 0"))


def test_a_large_panel_is_put_in_order_by_ranges_of_dates(small_panel, monkeypatch):
    whole = sorted(map(tuple, vd.index_panel(small_panel).collect()))
    monkeypatch.setattr(vd, "ORDERED_AT_ONCE", 0)
    kept = []
    parts = vd.index_panel(small_panel, lambda frames: kept.extend(frames) or staged(frames))
    assert len(kept) == vd.RANGES and sorted(map(tuple, parts.collect())) == whole
    assert all(f.select("date").intersect(g.select("date")).isEmpty() for i, f in enumerate(kept) for g in kept[:i])


def test_large_fits_do_not_run_side_by_side(small_panel, monkeypatch):
    indexed, plan = vd.index_panel(small_panel), vd.FoldPlan(train_days=50, step_days=25)
    assert vd._side_by_side(indexed, plan, 4) == 4
    monkeypatch.setattr(vd, "IN_FLIGHT", 300)
    assert vd._side_by_side(indexed, plan, 4) == 2
    monkeypatch.setattr(vd, "IN_FLIGHT", 1)
    assert vd._side_by_side(indexed, plan, 4) == 1


def test_boosted_classes_are_fitted_without_a_copy_of_the_vectors(small_panel, monkeypatch):
    def kept(*_):
        raise AssertionError("the vectors are stored")

    monkeypatch.setattr(type(small_panel), "persist", kept)
    rows = small_panel.withColumn("target", F.when(F.col("a") > 0.3, 1).when(F.col("a") < -0.3, -1).otherwise(0))
    model = models.train_classifier(rows, ["a"], kind="boosted", maxIter=2, maxDepth=2)
    monkeypatch.undo()
    assert models.predicted_class(model, rows).where("y_pred = target").count() > 0.9 * rows.count()


def test_light_retraining_stores_what_its_champion_reads(spark, sf_dir, monkeypatch):
    (panel,), _ = _called_with(monkeypatch, mq, "_champion", lambda: mq.light_retrain(spark, sf_dir))
    assert panel.columns == ["date", *mq.CHAMPION_FEATURES, "fwd_log_return"]

"""Every query with a DuckDB twin returns the twin's rows on the smallest data set; the others return rows."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, TWINS = entry.queries(), entry.oracle_sql()
# queries that fit models are slow; test_models exercises their functions on a small panel
MODEL_JOBS = {
    "permutation_test", "loo_accuracy", "param_search", "heavy_retrain", "light_retrain", "daily_inference",
    "train_classifier", "train_boosted", "score_probabilities", "top_features", "attribution_mean_abs", "walk_forward",
    "champion_challenger", "export_model", "oos_portfolio",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in MODEL_JOBS])
def test_query(spark, sf_dir, duck, name):
    note, _, _ = compare(spark, sf_dir, name, QUERIES[name], TWINS.get(name), duck)
    assert note.startswith(("ok", "rows")), note


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).schema == entry.entry(spark).schema

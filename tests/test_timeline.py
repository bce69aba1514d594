"""Ordered-series primitives against plain pandas, with blocks far smaller than the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe.operators import ewm, timeline as tl


def series(rows: int = 300, keys: tuple[str, ...] = ("a", "b"), seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for key in keys:
        dates = pd.Timestamp("2001-01-01") + pd.to_timedelta(np.sort(rng.choice(4000, rows, replace=False)), "D")
        parts.append(pd.DataFrame({"k": key, "d": dates.date, "x": rng.normal(size=rows)}))
    return pd.concat(parts).reset_index(drop=True)


@pytest.fixture(scope="module")
def data(spark):
    pdf = series()
    return pdf, spark.createDataFrame(pdf).withColumn("d", F.col("d").cast("date"))


def test_with_ordinal_matches_row_number(data):
    pdf, df = data
    buckets = [tl.date_bucket("d", 512), tl.date_bucket("d", 32)]
    got = tl.with_ordinal(df, ["k"], ["d"], buckets).toPandas().sort_values(["k", "d"])
    expected = pdf.sort_values(["k", "d"]).groupby("k").cumcount() + 1
    assert got["rn"].tolist() == expected.tolist()


def test_with_ordinal_without_keys(data):
    pdf, df = data
    got = tl.with_ordinal(df, [], ["d", "k"], [tl.date_bucket("d", 100)]).toPandas().sort_values(["d", "k"])
    assert got["rn"].tolist() == list(range(1, len(pdf) + 1))


@pytest.mark.parametrize("before_only", [False, True])
def test_running_sum_max_last(data, before_only):
    pdf, df = data
    positive = F.when(F.col("x") > 1, F.col("x"))
    got = tl.running(
        df, ["k"], ["d"], tl.date_bucket("d", 64), sums={"s": F.col("x")}, maxes={"m": F.col("x")},
        lasts={"l": positive}, before_only=before_only,
    ).toPandas().sort_values(["k", "d"]).reset_index(drop=True)
    pdf = pdf.sort_values(["k", "d"]).reset_index(drop=True)
    lag = (lambda s: s.groupby(pdf["k"]).shift()) if before_only else (lambda s: s)
    np.testing.assert_allclose(got["s"], lag(pdf.groupby("k")["x"].cumsum()).fillna(0), atol=1e-12)
    np.testing.assert_allclose(got["m"], lag(pdf.groupby("k")["x"].cummax()))
    np.testing.assert_allclose(got["l"], lag(pdf["x"].where(pdf["x"] > 1).groupby(pdf["k"]).ffill()))


def test_running_descending_last(data):
    pdf, df = data
    got = tl.running(
        df, ["k"], ["d"], tl.date_bucket("d", 64), lasts={"l": F.when(F.col("x") > 1, F.col("x"))}, descending=True
    ).toPandas().sort_values(["k", "d"])
    pdf = pdf.sort_values(["k", "d"])
    np.testing.assert_allclose(got["l"], pdf["x"].where(pdf["x"] > 1).groupby(pdf["k"]).bfill())


def test_halo_blocks_hold_the_rows_before_and_one_after(data):
    _, df = data
    numbered = tl.with_ordinal(df, ["k"], ["d"], [tl.date_bucket("d")])
    blocks = tl.halo_blocks(numbered, ["k"], "rn", block=50, halo=20).filter("k = 'a'").toPandas()
    third = sorted(blocks[blocks["_blk"] == 2]["rn"])
    assert third == list(range(81, 152))
    assert sorted(blocks[blocks["_own"]]["rn"]) == list(range(1, 301))
    assert sorted(blocks[blocks["_blk"] == 2]["_p"]) == list(range(71))


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("span", [3, 9, 26])
def test_ewm_matches_pandas_across_blocks(data, span, adjust):
    pdf, df = data
    numbered = tl.with_ordinal(df, ["k"], ["d"], [tl.date_bucket("d")])
    block = max(ewm.reach(span), 64) if span < 26 else None
    got = ewm.ewm(numbered, ["k"], "rn", "x", span, adjust, block=block).toPandas().sort_values(["k", "d"])
    expected = (
        pdf.sort_values(["k", "d"]).groupby("k")["x"].transform(lambda s: s.ewm(span=span, adjust=adjust).mean())
    )
    np.testing.assert_allclose(got["ewm"], expected, atol=1e-12)


def test_dense_dates(data):
    pdf, df = data
    got = tl.dense_dates(df, "d").toPandas().sort_values("d")
    assert got["date_idx"].tolist() == list(range(pdf["d"].nunique()))

"""Sliding results of blocks against Spark's windows, with nulls, and the plan of the panel's features."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantframe.operators import features as ft
from quantframe.operators.sliding import Step, slide


def test_steps_equal_windows(spark):
    """Every kind, bit for bit, on blocks of one row to more than a batch, some keys null, rows out of order."""
    draw = random.Random(3)
    sizes = {("a", 0): 1, ("a", 1): 90, (None, 1): 30, ("b", None): 12, ("c", 5): 3}
    rows = [(t, b, i, i // 20, i % 20, None if draw.random() < 0.2 else draw.gauss(0, 1)) for (t, b), n in sizes.items() for i in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "t string, b long, i int, seg int, q int, x double")
    steps = {
        "lag": Step("lag", "x", 3), "lead": Step("lag", "x", -1), "n": Step("count", "x", 4), "s": Step("sum", "x", 4), "z": Step("sum", "x", 2, zero=True),
        "m": Step("mean", "x", 9), "sd": Step("std", "x", 5), "s12": Step("steps", "s", 12, by=4), "z6": Step("steps", "z", 6, by=2, zero=True),
        "run": Step("running", "x", by=""), "part": Step("running", "x", by="seg"), "end": Step("carried", "part", 19, by="q"),
    }
    w, seg = Window.partitionBy("t", "b").orderBy("i"), Window.partitionBy("t", "b", "seg").orderBy("i")
    zero, first = F.lit(0.0), Window.unboundedPreceding
    frame = lambda n: w.rowsBetween(1 - n, 0)
    lagged = lambda c, n: F.lag(c, n).over(w)
    z = F.coalesce(F.sum("x").over(frame(2)), zero)
    expected = df.withColumns({
        "lag": lagged("x", 3), "lead": F.lead("x", 1).over(w), "n": F.count("x").over(frame(4)).cast("double"), "s": F.sum("x").over(frame(4)), "z": z,
        "m": F.avg("x").over(frame(9)), "sd": F.stddev_samp("x").over(frame(5)),
    })
    expected = expected.withColumns({
        "s12": F.col("s") + lagged("s", 4) + lagged("s", 8), "z6": F.col("z") + F.coalesce(lagged("z", 2), zero) + F.coalesce(lagged("z", 4), zero),
        "run": F.sum("x").over(w.rowsBetween(first, 0)), "part": F.sum("x").over(seg.rowsBetween(first, 0)),
    })
    ended = F.when(F.col("q") == 19, F.col("part"))
    expected = expected.withColumn("end", F.last(ended, ignorenulls=True).over(w.rowsBetween(first, -1)))
    got = slide(df.repartition(3, "t", "b").sortWithinPartitions("t", "b", "i"), ["t", "b"], steps).select(expected.columns)
    key = lambda r: (str(r.t), str(r.b), r.i)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    assert len({key(r) for r in got.collect()}) == sum(sizes.values())


def test_panel_features_need_no_window(spark):
    """The panel's frames were some ten windows, each of which copied every row; now only the short reference series have any."""
    bars = spark.range(600).selectExpr(
        "element_at(array('SPY', 'QQQ', 'VIX'), cast(id % 3 + 1 as int)) as ticker", "date_add(date'2020-01-01', cast(id / 3 as int)) as date", "floor(id / 3) + 1 as bar_no",
        "100 + rand(1) as open", "102 + rand(2) as high", "98 + rand(3) as low", "100 + rand(4) as close", "1.0 as volume",
    )
    tree = ft.compute(bars, ["log_returns", "bollinger", "rsi", "macd", "natr", "forward_return"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in tree and tree.count("MapInArrow") == 2

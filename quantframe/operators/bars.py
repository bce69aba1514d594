"""Cleaning and shaping of daily bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
CLOSE_HOUR = 16
INDEX_SYMBOLS = {"^VIX": "VIX"}


def market_cutoff(ts_utc: Column) -> Column:
    """Last date with a finished bar: yesterday before the New York close, else today."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), ts_utc)
    day = F.to_date(local)
    return F.when(F.hour(local) < CLOSE_HOUR, F.date_sub(day, 1)).otherwise(day)


def adj_close_default(bars: DataFrame) -> DataFrame:
    """Use the close where the feed has no adjusted close column."""
    return bars if "adj_close" in bars.columns else bars.withColumn("adj_close", F.col("close"))


def clean_bars(raw: DataFrame, cutoff: Column) -> DataFrame:
    """Drop holes and unfinished bars, require volume except for the index, normalise names."""
    is_index = F.col("ticker").isin(*INDEX_SYMBOLS)
    kept = raw.dropna(subset=["close", "date"]).filter(
        (F.col("date") <= cutoff) & (is_index | (F.col("volume") > 0))
    )
    name = F.col("ticker")
    for symbol, plain in INDEX_SYMBOLS.items():
        name = F.when(F.col("ticker") == symbol, F.lit(plain)).otherwise(name)
    return adj_close_default(kept.withColumn("ticker", name))


FIELDS = ("open", "high", "low", "close", "volume")


def ohlcv_melt(wide: DataFrame, tickers: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Wide frame with columns ``<ticker>_<Field>`` to one row per ticker and date."""
    entries = ", ".join(f"'{t}', " + ", ".join(f"`{t}_{f.title()}`" for f in fields) for t in tickers)
    melted = wide.selectExpr("date", f"stack({len(tickers)}, {entries}) as (ticker, {', '.join(fields)})")
    return melted.dropna(subset=["close"])


def batch_bounds(batch: DataFrame) -> DataFrame:
    """Tickers of a batch, each with the batch's overall first and last date."""
    span = batch.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    return batch.select("ticker").distinct().select(
        "ticker", span["lo"].alias("min_date"), span["hi"].alias("max_date")
    )


def lookback_scan(bars: DataFrame, day: Column, days: int) -> DataFrame:
    """Bars of the last ``days`` calendar days up to ``day``."""
    return bars.filter(F.col("date").between(F.date_sub(day, days), day))


def range_replace(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace everything the base holds for the batch's tickers inside the batch's date span."""
    bounds = batch_bounds(batch).withColumnRenamed("ticker", "_t")
    covered = (F.col("ticker") == F.col("_t")) & F.col("date").between(F.col("min_date"), F.col("max_date"))
    return base.join(bounds, covered, "left_anti").unionByName(batch)


def tick_bars(ticks: DataFrame, width: str = "1 day") -> DataFrame:
    """Ticks (ticker, ts, seq, price, qty) to open/high/low/close/volume per time window."""
    return ticks.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", F.struct("ts", "seq")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "seq")).alias("close"),
        F.sum("qty").alias("volume"),
    )

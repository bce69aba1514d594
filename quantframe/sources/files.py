"""File sources and sinks: panel store, raw archive, manifests, snapshots, reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe import schemas
from quantframe.session import shuffles_dropped, stored_bytes
from quantframe.sources.merged import names, remove

#: Stored bytes of reports that replace their folders in one go; more do so in turns.
WRITTEN_AT_ONCE, TURNS = 16 << 20, 8


def write_panel(bars: DataFrame, path: str) -> None:
    """One partition folder per ticker, rewritten whole; hot tickers spread over several files."""
    spread = bars.repartition("ticker", F.floor(F.unix_date("date") / F.lit(4096)))
    spread.write.mode("overwrite").partitionBy("ticker").parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def content_key(text: Column) -> Column:
    """Identity of a text."""
    return F.md5(text)


def doc_key(text: Column) -> Column:
    """Short key for names; different texts may share it."""
    return F.substring(F.md5(text), 1, 8)


def archive_rows(news: DataFrame, ingested_at: Column, source: str = "api_ingestion") -> DataFrame:
    """News items with their archive key; the same text on the same day is kept once."""
    stamped = news.withColumns(
        {
            "ingested_at": ingested_at,
            "source": F.lit(source),
            "doc_key": doc_key(F.col("text")),
            "content_key": content_key(F.col("text")),
            "year": F.date_format(ingested_at, "yyyy"),
            "month": F.date_format(ingested_at, "MM"),
            "day": F.date_format(ingested_at, "dd"),
        }
    )
    keys = ["year", "month", "day", "doc_key", "content_key"]
    rest = [c for c in stamped.columns if c not in keys]
    # a later write of the same key replaces the earlier one
    newest = stamped.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ingested_at", "url")).alias("_r"))
    return newest.select(*keys, "_r.*").withColumn(
        "s3_key", F.format_string("raw/news/%s/%s/%s/doc_%s.json", "year", "month", "day", "content_key")
    )


#: Ends a text record; report texts hold line breaks.
RECORD_END = "\x1e"
DAY_PARTS = ["year", "month", "day"]


def write_archive(rows: DataFrame, path: str) -> None:
    """Append the texts that their day does not hold yet, so that a repeated run adds nothing.

    Only the folders of the batch's days are read: their names are collected, at most one per calendar day.
    """
    spark = rows.sparkSession
    if names(spark, path):
        days = [tuple(r) for r in rows.select(*DAY_PARTS).distinct().collect()]
        held = [f"{path}/year={y}/month={m}/day={d}" for y, m, d in days if names(spark, f"{path}/year={y}/month={m}/day={d}")]
        if held:
            lake = spark.read.schema(rows.schema).option("basePath", path).json(held).select(*DAY_PARTS, "content_key")
            rows = rows.join(lake, [*DAY_PARTS, "content_key"], "left_anti")
    rows.write.mode("append").partitionBy(*DAY_PARTS).json(path)


def write_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Write rows by day; the days of the batch are replaced, other days stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def drop_days(spark: SparkSession, path: str, first: str, day: str = "day") -> list[str]:
    """Delete the day folders before ``first`` (as their names sort) without reading them; their names."""
    old = [n for n in names(spark, path) if n.startswith(f"{day}=") and n.partition("=")[2] < first]
    for name in old:
        remove(spark, f"{path}/{name}")
    return old


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add a run's (run, key, value) rows; writing a run again replaces its own rows only."""
    write_days(metrics, path, "run")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value double, run string").parquet(path).select("run", "key", "value")


def feature_snapshot(signals: DataFrame) -> DataFrame:
    """Key columns and the ``feat_`` columns without their prefix."""
    features = [c for c in signals.columns if c.startswith("feat_")]
    return signals.select("ticker", "signal_date", *[F.col(c).alias(c.removeprefix("feat_")) for c in features])


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("overwrite").csv(path, header=True)


def write_reports(reports: DataFrame, path: str, span: str = "yyyy-MM-dd") -> None:
    """Text files by ticker and span of dates (a day, or a longer one) from ``reports(ticker, date, report)``.

    The folders of the batch are replaced, those of a large batch some at a time: what replaces a folder lies beside it until
    then.  ``reports`` are read as often, so stage them.  A report starts with a line that holds its date and ends with a record separator,
    so that several of a folder read back as they were.
    """
    value = F.concat(F.col("date").cast("string"), F.lit("\n"), F.col("report"))
    spread = reports.select("ticker", F.date_format("date", span).alias("span"), value.alias("value"))
    turns = 1 if stored_bytes(reports) <= WRITTEN_AT_ONCE else TURNS
    for turn in range(turns):
        some = spread if turns == 1 else spread.filter(F.pmod(F.xxhash64("ticker", "span"), F.lit(turns)) == turn)
        writer = some.repartition("ticker", "span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        with shuffles_dropped(reports.sparkSession):
            writer.partitionBy("ticker", "span").text(path, lineSep=RECORD_END)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, date, report`` of written reports."""
    rows = spark.read.schema("value string, ticker string, span string").text(path, lineSep=RECORD_END)
    head = F.substring_index("value", "\n", 1)
    return rows.select("ticker", head.cast("date").alias("date"), F.substring(F.col("value"), F.length(head) + 2, F.length("value")).alias("report"))


def manifest_frame(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    """Model manifest as a one-row frame; absent entries are null."""
    row = tuple(values.get(f.name) for f in schemas.MANIFEST)
    return spark.createDataFrame([row], schemas.MANIFEST)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)


def as_tool_array(expected: Column) -> Column:
    """A tool name, or a JSON list of names, as an array."""
    listed = F.from_json(expected, T.ArrayType(T.StringType()))
    return F.when(F.startswith(F.ltrim(expected), F.lit("[")), listed).otherwise(F.array(expected))


def load_tool_eval(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.TOOL_EVAL).json(path, multiLine=True)
    return raw.withColumn("expected_tool", as_tool_array(F.col("expected_tool")))

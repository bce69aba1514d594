"""Given tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession) -> None:
    """Rows that Spark hands to Python at a time: whole texts are long, and two tasks share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few short columns that may travel to every executor.
TRAVELLING = 1 << 19


def travelling(df: DataFrame) -> DataFrame:
    """A written frame of short rows, sent to every executor if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(TRAVELLING + 1).count() <= TRAVELLING else df


def files_for(df: DataFrame, rows: int = 1 << 19) -> int:
    """How many files of about ``rows`` rows hold at most as many rows as a written frame has."""
    return -(-df.count() // rows) or 1

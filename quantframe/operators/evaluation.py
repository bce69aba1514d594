"""Scores of recorded tool calls and judged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

API_ERROR = "API_ERROR"


def tool_match(calls: DataFrame) -> DataFrame:
    """``is_correct``: the called tool is one of the expected; a call that failed everywhere is wrong."""
    hit = F.array_contains("expected_tool", F.col("called_tool")) & (F.col("called_tool") != API_ERROR)
    return calls.withColumn("is_correct", F.coalesce(hit, F.lit(False)))


def tool_accuracy(calls: DataFrame) -> DataFrame:
    matched = tool_match(calls)
    return matched.agg(
        (F.avg(F.col("is_correct").cast("double")) * 100).alias("tool_calling_accuracy"),
        F.count(F.lit(1)).alias("dataset_size"),
        F.count(F.when(~F.col("is_correct"), 1)).alias("n_failed"),
    )


def failed_cases(calls: DataFrame) -> DataFrame:
    return tool_match(calls).filter(~F.col("is_correct")).drop("is_correct")


def rag_scores(judged: DataFrame) -> DataFrame:
    """Mean scores in percent over all cases; errors count as zero."""
    n = F.count(F.lit(1))

    def mean(name: str):
        return F.coalesce(F.sum(F.coalesce(F.col(name), F.lit(0.0))) / n * 100, F.lit(0.0))

    return judged.agg(
        mean("faithfulness").alias("avg_faithfulness"), mean("relevance").alias("avg_relevance"), n.alias("n_cases")
    )

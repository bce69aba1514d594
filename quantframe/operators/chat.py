"""Conversations: access, history, credits and rate counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.operators.timeline import id_bucket, running, with_ordinal
from quantframe.session import staged

# Credits charged per answer by model, and the defaults around them.
MODEL_COSTS = {
    "gemini-3.5-flash": 2.0,
    "gemini-3-flash-preview": 2.0,
    "gemini-2.5-flash": 1.0,
    "gemini-3.1-pro-preview": 5.0,
    "gemini-2.5-pro": 3.0,
    "gemini-3.1-flash-lite": 0.5,
    "gemini-2.5-flash-lite": 0.5,
}
UNKNOWN_COST, START_CREDITS = 1.0, 100.0
FAILED = "failed_all"
RATE_LIMIT, RATE_WINDOW = 5, "1 minute"


def message_cost(model: Column, is_cached: Column) -> Column:
    """Cost of an answer; cached and failed ones are free."""
    costs = F.create_map(*[F.lit(x) for pair in MODEL_COSTS.items() for x in pair])
    priced = F.coalesce(F.try_element_at(costs, model), F.lit(UNKNOWN_COST))
    return F.when(is_cached | (model == FAILED), F.lit(0.0)).otherwise(priced)


LEDGER_BLOCK = 65536


def credit_ledger(messages: DataFrame, start: float = START_CREDITS, spent: DataFrame | None = None) -> DataFrame:
    """Charge, blocking and remaining credits per answer, in order of (conv_id, turn).

    ``messages`` has user_id, conv_id, turn, model and is_cached.  Credits are never topped up, so
    a user is blocked from the first message on whose preceding costs use them up.  Positions are
    numbered first, so that the running sums work on blocks of equal size however long one
    conversation or one user's history is.  ``spent(user_id, spent)``: what users have used before.
    """
    priced = messages.withColumn("cost", message_cost(F.col("model"), F.col("is_cached")))
    zero = F.lit(0.0)
    if spent is None:
        priced = priced.withColumn("_used", zero)
    else:
        # one row a user: the planner sends it along or splits the hot user's side
        priced = priced.join(spent.withColumnRenamed("spent", "_used"), "user_id", "left").fillna(0.0, ["_used"])
    buckets = [id_bucket("conv_id"), F.col("conv_id"), id_bucket("turn", 4096)]
    numbered = staged(with_ordinal(priced, ["user_id"], ["conv_id", "turn"], buckets, "_n"))
    block = id_bucket("_n", LEDGER_BLOCK)
    before = running(numbered, ["user_id"], ["_n"], block, sums={"_spent": F.col("cost")}, before_only=True)
    decided = before.withColumn("blocked", F.col("_spent") + F.col("_used") >= start).drop("_spent")
    charged = decided.withColumn("cost", F.when(F.col("blocked"), zero).otherwise(F.col("cost")))
    total = running(charged, ["user_id"], ["_n"], block, sums={"_paid": F.col("cost")})
    return total.withColumn("credits_remaining", F.lit(start) - F.col("_used") - F.col("_paid")).drop("_paid", "_n", "_used")


def message_history(messages: DataFrame, bucket_width: int = 1024) -> DataFrame:
    """Messages before the latest user message of each conversation, numbered in order.

    The history stays rows (conv_id, pending_turn, position, role, text): a conversation of any
    length is never gathered in one value.
    """
    pending = messages.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("pending_turn"))
    earlier = messages.join(pending, "conv_id").filter(F.col("turn") < F.col("pending_turn"))
    return with_ordinal(earlier, ["conv_id"], ["turn"], [id_bucket("turn", bucket_width)], "position")


def conversation_access(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Requests with ``granted``: the conversation exists and belongs to the requester."""
    keys = ["conv_id", "user_id", "tenant_id"]
    owners = conversations.select(*keys).distinct()
    granted = requests.join(owners, keys, "left_semi").withColumn("granted", F.lit(True))
    rejected = requests.join(owners, keys, "left_anti").withColumn("granted", F.lit(False))
    return granted.unionByName(rejected)


def rate_key(authorization: Column, address: Column) -> Column:
    """The authorization header identifies a caller, else the address."""
    return F.coalesce(F.when(authorization != "", authorization), address)


def rate_flags(requests: DataFrame, width: str = RATE_WINDOW, limit: int = RATE_LIMIT) -> DataFrame:
    """Requests per caller and tumbling window, flagged above the limit; batch or stream."""
    counted = requests.groupBy("caller", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("caller", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("flagged"))

"""Price alerts: validation, change log, matching and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions.reports import alert_message

CONDITIONS = ("above", "below")
MAX_TICKER = 10


def rejection_reasons(ticker: Column, target_price: Column, condition: Column) -> Column:
    """Names of the fields that break the request rules."""
    length = F.coalesce(F.length(ticker), F.lit(0))
    checks = F.array(
        F.when((length < 1) | (length > MAX_TICKER), F.lit("ticker")),
        F.when(~F.coalesce(target_price > 0, F.lit(False)), F.lit("target_price")),
        F.when(~F.coalesce(condition.isin(*CONDITIONS), F.lit(False)), F.lit("condition")),
    )
    return F.filter(checks, lambda r: r.isNotNull())


def validate_alerts(requests: DataFrame) -> DataFrame:
    """Requests with their rejection reasons (empty when valid) and upper-cased ticker."""
    reasons = rejection_reasons(F.col("ticker"), F.col("target_price"), F.col("condition"))
    return requests.withColumns({"reasons": reasons, "ticker": F.upper("ticker")})


def create_alerts(requests: DataFrame) -> DataFrame:
    """New active alerts from the valid requests."""
    valid = validate_alerts(requests).filter(F.size("reasons") == 0)
    return valid.drop("reasons").withColumn("status", F.lit("active"))


def apply_alert_changes(log: DataFrame) -> DataFrame:
    """Final state of each alert after its change log.

    The log has alert_id, seq, op (create, update, cancel, trigger), target_price, tenant_id and
    user_id.  The first create counts.  Owners alone may update (only while the alert is active)
    and cancel (always, so a triggered alert can end as cancelled).  Everything is an aggregate
    or a join on the alert, so a long log of one alert is combined before it is shuffled.
    """
    created = (
        log.filter(F.col("op") == "create")
        .groupBy("alert_id")
        .agg(F.min_by(F.struct("seq", "target_price", "tenant_id", "user_id"), "seq").alias("_c"))
        .select(
            "alert_id", F.col("_c.seq").alias("_seq0"), F.col("_c.target_price").alias("_price0"),
            F.col("_c.tenant_id").alias("tenant_id"), F.col("_c.user_id").alias("user_id"),
        )
    )
    changes = log.filter(F.col("op") != "create").select(
        "alert_id", "seq", "op", "target_price", F.col("tenant_id").alias("_t"), F.col("user_id").alias("_u")
    )
    owned = (F.col("_t") == F.col("tenant_id")) & (F.col("_u") == F.col("user_id"))
    effective = changes.join(created, "alert_id").filter(
        (F.col("seq") > F.col("_seq0")) & ((F.col("op") == "trigger") | owned)
    )
    ends = (
        effective.filter(F.col("op").isin("cancel", "trigger"))
        .groupBy("alert_id")
        .agg(F.min("seq").alias("_end"), F.max((F.col("op") == "cancel").cast("int")).alias("_cancelled"))
    )
    updates = (
        effective.filter(F.col("op") == "update")
        .join(ends.select("alert_id", "_end"), "alert_id", "left")
        .filter(F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
        .groupBy("alert_id")
        .agg(F.max_by("target_price", "seq").alias("_price"))
    )
    status = F.when(F.col("_cancelled") == 1, "cancelled").when(F.col("_end").isNotNull(), "triggered")
    return (
        created.join(ends, "alert_id", "left")
        .join(updates, "alert_id", "left")
        .select(
            "alert_id", "tenant_id", "user_id",
            F.coalesce("_price", "_price0").alias("target_price"), status.otherwise("active").alias("status"),
        )
    )


def tenant_filter(rows: DataFrame, tenant_id: str, user_id: str | None = None) -> DataFrame:
    """Rows of one tenant (and user); applied first so that it reaches the scan."""
    mine = rows.filter(F.col("tenant_id") == tenant_id)
    return mine if user_id is None else mine.filter(F.col("user_id") == user_id)


def active_alerts(alerts: DataFrame, tenant_id: str, user_id: str | None = None) -> DataFrame:
    return tenant_filter(alerts, tenant_id, user_id).filter(F.col("status") == "active")


def current_prices(ticks: DataFrame) -> DataFrame:
    """Last price per ticker."""
    return ticks.groupBy("ticker").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))


def fires(condition: Column, price: Column, target: Column) -> Column:
    return ((condition == "above") & (price >= target)) | ((condition == "below") & (price <= target))


def alert_match(alerts: DataFrame, prices: DataFrame) -> DataFrame:
    """Active alerts whose condition the current price meets, with the notification text."""
    known = prices.filter(F.col("price").isNotNull() & (F.col("price") != 0))
    met = alerts.filter(F.col("status") == "active").join(known, "ticker")
    met = met.filter(fires(F.col("condition"), F.col("price"), F.col("target_price")))
    message = alert_message(F.col("ticker"), F.col("condition"), F.col("target_price"), F.col("price"))
    return met.withColumns({"message": message, "status": F.lit("triggered")})


INACTIVE = ("triggered", "cancelled")


def prune_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("status").isin(*INACTIVE))


def pruned_count(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status").isin(*INACTIVE)).agg(F.count(F.lit(1)).alias("deleted"))

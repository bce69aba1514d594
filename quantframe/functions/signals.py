"""Column expressions for labels, decisions and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability below which a signal is cold, and the default realised-return limits.
GREY_FLOOR = 0.38
DEFAULT_LIMITS = (0.002, -0.002)


def label(value: Column, high: Column | float, low: Column | float, inclusive: bool = False) -> Column:
    """1 above the high limit, -1 below the low one, else 0."""
    high = F.lit(high) if isinstance(high, float) else high
    low = F.lit(low) if isinstance(low, float) else low
    up, down = (value >= high, value <= low) if inclusive else (value > high, value < low)
    return F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0))


def action_name(code: Column) -> Column:
    return F.when(code == 1, "BUY").when(code == -1, "SELL").otherwise("HOLD")


def decide(p_buy: Column, p_sell: Column, buy_at: float, sell_at: float, priority: str = "sell") -> Column:
    """Thresholded class; ``priority`` wins when both thresholds are reached."""
    buy, sell = p_buy >= F.lit(buy_at), p_sell >= F.lit(sell_at)
    if priority == "sell":
        return F.when(sell, F.lit(-1)).when(buy, F.lit(1)).otherwise(F.lit(0))
    if priority == "buy":
        return F.when(buy, F.lit(1)).when(sell, F.lit(-1)).otherwise(F.lit(0))
    raise ValueError("priority is 'buy' or 'sell'")


def conviction(p_buy: Column, p_sell: Column, buy_at: float, sell_at: float) -> dict[str, Column]:
    """Decision, zone, leaning action and probability of a scored row."""
    best = F.greatest(p_buy, p_sell)
    hot_buy, hot_sell = p_buy >= F.lit(buy_at), p_sell >= F.lit(sell_at)
    grey = (best >= F.lit(GREY_FLOOR)) & (best < F.lit(max(buy_at, sell_at)))
    return {
        "ml_decision": F.when(hot_buy, "BUY").when(hot_sell, "SELL").otherwise("HOLD"),
        "conviction_zone": F.when(hot_buy | hot_sell, "HOT").when(grey, "GREY").otherwise("COLD"),
        "leaning_action": F.when(hot_buy, "BUY")
        .when(hot_sell, "SELL")
        .when(grey & (p_buy > p_sell), "BUY")
        .when(grey, "SELL")
        .otherwise("HOLD"),
        "probability": best,
    }


def parse_verdict(answer: Column) -> Column:
    """First of BUY, SELL, HOLD contained in the upper-cased answer, else the answer itself."""
    text = F.upper(F.trim(answer))
    chain = F.when(F.contains(text, F.lit("BUY")), "BUY")
    for word in ("SELL", "HOLD"):
        chain = chain.when(F.contains(text, F.lit(word)), word)
    return chain.otherwise(text)


def consults(zone: Column, has_news: Column) -> Column:
    return (zone == "HOT") | ((zone == "GREY") & F.coalesce(has_news, F.lit(False)))


def verdict(zone: Column, has_news: Column, leaning: Column, answer: Column) -> Column:
    """Final decision of a signal.

    Only hot signals and grey ones with news look at the external answer.  A hot signal without
    news trusts its leaning; an answer that is missing counts as a failed call, so HOLD.
    """
    news = F.coalesce(has_news, F.lit(False))
    return (
        F.when(~consults(zone, has_news), "HOLD")
        .when(answer.isNotNull(), parse_verdict(answer))
        .when((zone == "HOT") & ~news, leaning)
        .otherwise("HOLD")
    )

"""Text columns: news lines, audit reports and notifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_NEWS = "(nothing published about it in these days)"
COLD_NEWS = "(not looked up: the signal is cold)"


def news_text(title: Column, description: Column, published_at: Column, url: Column) -> Column:
    return F.concat(
        F.lit("TITLE: "), title, F.lit(". DESCRIPTION: "), description, F.lit(". DATE: "), published_at,
        F.lit(". URL: "), url,
    )


def age_label(seconds: Column) -> Column:
    """TODAY, 1 DAY AGO or N DAYS AGO; half days round to even, never negative."""
    days = F.greatest(F.bround(seconds / 86400.0, 0), F.lit(0.0)).cast("long")
    return (
        F.when(days == 0, "TODAY")
        .when(days == 1, "1 DAY AGO")
        .otherwise(F.concat(days.cast("string"), F.lit(" DAYS AGO")))
    )


def news_line(age: Column, text: Column, sentiment: Column, score: Column) -> Column:
    return F.format_string("- %s | %s | %s %.2f", age, text, sentiment, score)


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value * 100)


def audit_markdown(
    ticker: Column, day: Column, decision: Column, leaning: Column, zone: Column, probability: Column,
    drivers: Column, final: Column, consulted: Column, context: Column,
) -> Column:
    """Report of one signal as a table of what was decided, and the news it was decided on."""
    rows = {
        "model": decision, "leaning": leaning, "zone": zone, "probability": percent(probability), "drivers": drivers,
        "second opinion": F.when(consulted, F.lit("asked")).otherwise(F.lit("not asked")), "verdict": final,
    }
    lines = [F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n")) for name, value in rows.items()]
    head = F.concat(ticker, F.lit(" on "), day.cast("string"), F.lit("\n\n| step | outcome |\n| --- | --- |\n"))
    return F.concat(head, *lines, F.lit("\nNews:\n"), context, F.lit("\n"))


def alert_message(ticker: Column, condition: Column, target: Column, price: Column) -> Column:
    return F.concat(ticker, F.lit(" is now "), price.cast("string"), F.lit(" USD ("), condition, F.lit(" "), target.cast("string"), F.lit(")"))

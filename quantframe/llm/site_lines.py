"""Site-relative line frequency: lines that stand on too large a share of a site's pages are dropped.

DataFrame functions only.  A page's lines are counted once per page and once per distinct content, so a
page that is mirrored a thousand times is not mistaken for a template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.session import staged

#: Fixed patterns, the same in Java and RE2.
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
BLOCK = r"(?i)</?(?:title|p|div|br|h[1-6]|li|ul|ol|nav|article|section|header|footer|table|tr|td|body|head|html|pre)(?:[ \t\r\n/][^>]*)?>"
TAG = r"<[^>]*>"
GAPS = r"[ \t\r\f\x0B]+"


def visible(html: Column) -> Column:
    """Text of a page, a line per block element."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")


def host_of(url: Column) -> Column:
    """Lower-cased host without a port; a missing or odd URL gives the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _normals(text: Column) -> Column:
    """Every line of a text in lower case with runs of blanks as one; blanks are replaced in the whole text at once."""
    return F.transform(F.split(F.lower(F.regexp_replace(text, GAPS, " ")), "\n"), lambda line: F.trim(line))


def _on_different_pages(facts: DataFrame, common: DataFrame, ratio: float, least: int) -> DataFrame:
    """Those of ``common(_host, key, n, pages)`` that reach the ratio of their length on pages of different longest lines."""
    common = staged(common)
    lists = common.groupBy("_host").agg(F.collect_list("key").alias("_drop"))
    found = F.filter(F.array_distinct("_marks"), lambda x: F.array_contains("_drop", x["key"]))
    held = facts.join(lists, "_host").select("_host", F.array_max("_marks")["key"].alias("longest"), F.explode(found).alias("mark"))
    held = held.select("_host", "mark.key", "mark.size", "longest").distinct()
    held = held.groupBy("_host", "key").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("longests"))
    reached = F.col("n") * F.col("size") >= F.lit(ratio) * F.col("pages")
    return common.join(held, ["_host", "key"]).where(reached & (F.col("longests") >= least) & (2 * F.col("longests") >= F.col("n")))


def drop_site_lines(
    pages: DataFrame, host: str, text: str, boilerplate_ratio: float = 0.1, min_pages: int = 3, floor: float | None = None
) -> DataFrame:
    """Add ``kept_text``, ``n_lines`` and ``n_dropped`` to ``pages``.

    A non-blank line is dropped where it stands on at least ``boilerplate_ratio`` of the host's distinct
    page contents and on at least ``min_pages`` of them.  Lines are compared in lower case with runs of
    blanks as one; blank lines stay.  A null text has no lines and stays null; an empty one stays empty;
    a null host is a host of its own.  Every row returns, repeated rows included, with its own columns; a column
    that has the name of one of the three results is replaced by it.

    With ``floor`` the ratio falls with the line's length: ``boilerplate_ratio`` divided by its characters, but
    not under ``floor``.  Short lines recur by chance, long ones do not.  As so low a ratio would also meet
    what near copies of one page share, such a line must stand on pages that differ otherwise: their
    distinct longest lines number at least ``min_pages`` and half the page contents.

    A line above the ratio uses up that share of its host's lines, so a host has at most (mean lines per
    page) / ratio (or floor) of them: that small list per host is what meets the pages, not a join by line.
    """
    made, results = ("_host", "_lines", "_keys", "_page", "_drop"), ("kept_text", "n_lines", "n_dropped")
    prefix = "_input"
    while any(c.lower().startswith(prefix) for c in pages.columns):
        prefix += "_"
    aside = {c: f"{prefix}{i}" for i, c in enumerate(pages.columns) if c.lower() in (*made, *results)}
    pages, host, text = pages.withColumnsRenamed(aside), aside.get(host, host), aside.get(text, text)
    lines = F.when(F.col(text).isNull(), F.array().cast("array<string>")).otherwise(F.split(F.col(text), "\n"))
    read = pages.withColumns({"_host": F.coalesce(F.col(host).cast("string"), F.lit("\0")), "_lines": lines})
    normals = F.when(F.col(text).isNull(), F.array().cast("array<string>")).otherwise(_normals(F.col(text)))
    bodies = F.filter(normals, lambda x: x != "")
    marks = F.transform(bodies, lambda x: F.struct(F.length(x).alias("size"), F.xxhash64(x).alias("key")))

    # a null key stands for the page itself, so one pass over the texts gives lines and page totals
    facts = read.where(F.col(text).isNotNull()).select("_host", F.xxhash64(text).alias("_page"), marks.alias("_marks"))
    facts = facts if floor is None else staged(facts)
    every = F.concat(F.array_distinct("_marks.key"), F.array(F.lit(None).cast("bigint")))
    counted = facts.select("_host", "_page", F.explode(every).alias("key")).distinct().groupBy("_host", "key").agg(F.count(F.lit(1)).alias("n"))
    counted = staged(counted.where(F.col("key").isNull() | (F.col("n") >= min_pages)))
    totals = counted.where("key is null").select("_host", F.col("n").alias("pages"))
    common = counted.where("key is not null").join(totals, "_host").where(F.col("n") >= F.lit(boilerplate_ratio if floor is None else floor) * F.col("pages"))
    if floor is not None:
        common = _on_different_pages(facts, common, boilerplate_ratio, min_pages)
    common = common.groupBy("_host").agg(F.collect_list("key").alias("_drop"))

    joined = read.join(common, "_host", "left").withColumn("_drop", F.coalesce("_drop", F.array().cast("array<bigint>")))
    lined = F.zip_with("_lines", normals, lambda x, y: F.struct(x.alias("line"), y.alias("normal")))
    stays = F.filter(lined, lambda x: (x["normal"] == "") | ~F.array_contains("_drop", F.xxhash64(x["normal"])))
    kept = joined.withColumn("_keys", F.transform(stays, lambda x: x["line"]))
    out = kept.withColumns(
        {
            "kept_text": F.when(F.col(text).isNotNull(), F.array_join("_keys", "\n")),
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": (F.size("_lines") - F.size("_keys")).cast("long"),
        }
    )
    back = {new: old for old, new in aside.items() if old.lower() in made}
    return out.drop(*made, *(new for new in aside.values() if new not in back)).withColumnsRenamed(back)

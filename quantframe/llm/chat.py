"""Conversations without quotes: quoted passages are parsed, linked to the messages they come from, and removed.

DataFrame functions only.  A line's quote level is the number of ``>`` marks it begins with.  The quoted
lines of one level that stand together are a passage; passages and the paragraphs that messages wrote
themselves are compared by the hash of their normalised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.graph import components
from quantframe.session import staged

#: Fixed patterns, the same in Java and RE2: the marks that open a quoted line, and a line that announces a quote.
MARKS = r"^[ \t]*(?:>[ \t]*)+"
INTRO = r"(?i)^[ \t]*(?:on .{1,200} wrote|.{1,100} writes|le .{1,200} a écrit|am .{1,200} schrieb|el .{1,200} escribió)[ \t]*:[ \t]*$"
GAPS = r"[ \t\r\f\x0B]+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), GAPS, " ")))


def _passages(levels: Column, normals: Column) -> Column:
    """Runs of non-blank lines of one level: an array of (level, text), texts joined by a blank."""
    start = F.struct(F.lit(0).alias("level"), F.lit("").alias("text"))
    empty = F.array().cast("array<struct<level:int,text:string>>")

    def step(state: Column, line: Column) -> Column:
        level, text = line["level"], line["text"]
        joins = (state["open"]["text"] != "") & (text != "") & (state["open"]["level"] == level)
        grown = F.struct(level.alias("level"), F.when(joins, F.concat(state["open"]["text"], F.lit(" "), text)).otherwise(text).alias("text"))
        closed = F.when(joins | (state["open"]["text"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(closed.alias("done"), grown.alias("open"))

    lines = F.zip_with(levels, normals, lambda a, b: F.struct(a.alias("level"), b.alias("text")))
    begin = F.struct(empty.alias("done"), start.alias("open"))
    end = F.struct(F.lit(-1).alias("level"), F.lit("").alias("text"))
    return F.aggregate(F.concat(lines, F.array(end)), begin, step, lambda s: s["done"])


def link_quotes(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` without quotes, with their links, in reply order.

    Returns one row per input row: ``conv_id, turn, role, clean_text, max_level, n_quotes, parent_conv,
    parent_turn, thread_id, linked``.  A quote of level 1 is answered by the message; deeper levels are
    quotes of quotes.  A passage's original is the earliest message, by (turn, conv_id) and before the quoting
    one, that wrote it as a paragraph of its own: in the same conversation if there is one, else anywhere.
    The parent is the latest original of the passages of the lowest level that has one; without any it is null
    and the message follows its turn (``linked`` false).  Conversations joined by a quote share a thread, named by
    the smallest conv_id; by (thread_id, turn, conv_id) every message comes after its parent.  The lines that
    announce a quote go with it.  A null or empty text has nothing; null conv_id or turn link with nothing;
    repeated rows are handled alike; other columns are ignored.
    """
    source = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    read = source.withColumn("lines", lines)
    read = read.withColumn("levels", F.transform("lines", _level)).withColumn("normals", F.transform("lines", _normal))
    last = F.size("lines") - 1
    own = F.filter(
        F.transform("lines", lambda x, i: F.when((F.element_at("levels", i + 1) == 0) & ~(x.rlike(INTRO) & (i < last) & (F.element_at("levels", F.least(i + 2, last + 1)) > 0)), x)),
        lambda x: x.isNotNull(),
    )
    read = read.withColumns({"clean_text": F.when(F.col("text").isNotNull(), F.array_join(own, "\n")), "passages": _passages(F.col("levels"), F.col("normals"))})
    read = read.withColumns(
        {
            "max_level": F.coalesce(F.array_max("levels"), F.lit(0)).cast("long"),
            "quotes": F.filter("passages", lambda p: p["level"] > 0),
        }
    ).withColumn("n_quotes", F.size("quotes").cast("long"))
    kept = staged(read.select("conv_id", "turn", "role", "clean_text", "max_level", "n_quotes", "quotes", F.filter("passages", lambda p: p["level"] == 0)["text"].alias("said")))

    placed = kept.where("conv_id is not null and turn is not null")
    key = F.md5(F.col("p").cast("binary"))
    asked = staged(placed.where("n_quotes > 0").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", F.col("q.text").alias("p")).withColumn("key", key).drop("p").distinct())
    wanted = asked.select("key").distinct()
    said = placed.select("conv_id", "turn", F.explode("said").alias("p")).select("conv_id", "turn", key.alias("key")).join(wanted, "key", "left_semi")
    # one row per passage and conversation, combined before the shuffle: the earliest message that wrote it
    near = staged(said.groupBy("key", "conv_id").agg(F.min("turn").alias("turn")))
    far = near.groupBy("key").agg(F.min(F.struct("turn", "conv_id")).alias("first"))
    found = asked.join(near.withColumnRenamed("turn", "near_turn"), ["key", "conv_id"], "left").join(far, "key", "left")
    here = F.col("near_turn") < F.col("turn")
    there = F.struct(F.col("first.turn"), F.col("first.conv_id")) < F.struct(F.col("turn"), F.col("conv_id"))
    origin = F.when(here, F.struct(F.col("near_turn").alias("turn"), F.col("conv_id").alias("conv_id"))).when(
        there, F.struct(F.col("first.turn").alias("turn"), F.col("first.conv_id").alias("conv_id"))
    )
    found = staged(found.select("conv_id", "turn", "level", origin.alias("origin")).where("origin is not null"))
    # lowest level first, then the latest original
    parents = found.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("origin.turn"), F.col("origin.conv_id").alias("from_conv"))).alias("best"))
    parents = parents.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("best.from_conv").alias("parent_conv"), F.col("best.turn").alias("parent_turn"))
    threads = components(found.select(F.col("conv_id").alias("a"), F.col("origin.conv_id").alias("b")))
    out = kept.join(parents, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    out = out.join(threads.withColumnRenamed("component", "thread"), F.col("conv_id") == F.col("id"), "left")
    return out.select(
        "conv_id", "turn", "role", "clean_text", "max_level", "n_quotes", "parent_conv", "parent_turn", F.coalesce("thread", "conv_id").alias("thread_id"), F.col("parent_turn").isNotNull().alias("linked")
    )


def conversations(linked: DataFrame) -> DataFrame:
    """The messages of ``link_quotes`` in reply order, range-sorted so that a thread's messages follow each other."""
    n = max(1, int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ("thread_id", "turn", "conv_id")
    return linked.repartitionByRange(n, *keys, F.xxhash64("clean_text")).sortWithinPartitions(*keys)

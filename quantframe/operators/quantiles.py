"""Exact linear-interpolated quantiles from mergeable sketches, without gathering a large group in one task.

Rows belong to pieces, and a group is a set of pieces (a fold of a walk-forward run is a run of date steps; a plain key is
one piece).  Each piece has one KLL sketch; the sketches of a group's pieces are merged, which brackets every
wanted rank.  Exact counts of the brackets come from counts per piece and interval, so no row is copied per group; only
the rows inside a bracket are, and they are narrowed by value ranges until few distinct values are left to rank.  A bracket
that the counts disprove is opened and counted again, so the result does not depend on the sketch's accuracy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.session import staged

#: Size of a sketch, and the share of rows by which a bracket reaches beyond the wanted rank on either side.
SKETCH, SLACK = 4096, 0.002
#: Rows of a key up to which the built-in exact percentile holds them.
SMALL = 200_000
#: Distinct values that are ranked in one task, and the value ranges that narrow a larger bracket.
RANKED, RANGES = 8192, 1024


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """One row per key with a column per wanted quantile (as numpy's default, linear); null values do not count.

    Counts the rows per key first; reads ``df`` once more for small keys and three times for large ones, with
    the key and value columns only.  Stage it first when it is costly.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sizes = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0))
    small, large = sizes.filter(F.col("_n") <= SMALL), sizes.filter(F.col("_n") > SMALL)
    parts = []
    if not large.isEmpty():
        if keys:
            members = large.select(*keys, *[F.col(k).alias(f"_p_{k}") for k in keys])
            pieces = rows.join(large.select(*keys), keys, "left_semi").select(*[F.col(k).alias(f"_p_{k}") for k in keys], "_v")
            parts.append(piece_quantiles(pieces, [f"_p_{k}" for k in keys], members, keys, "_v", wanted))
        else:
            members = large.select(F.lit(0).alias("_all"), F.lit(0).alias("_p"))
            parts.append(piece_quantiles(rows.withColumn("_p", F.lit(0)), ["_p"], members, ["_all"], "_v", wanted).drop("_all"))
    if not small.isEmpty() or not parts:
        some = rows.join(small.select(*keys), keys, "left_semi") if keys and parts else rows
        exact = some.groupBy(*keys).agg(F.percentile("_v", list(wanted.values())).alias("_q"))
        parts.append(exact.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(wanted)]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _brackets(sketches: DataFrame, members: DataFrame, pieces: list[str], groups: list[str], wanted: Mapping[str, float]) -> DataFrame:
    """``groups, name, rank, low, high, least, most``: a value range that should hold the wanted (fractional) rank."""
    merged = members.join(sketches, pieces).groupBy(*groups).agg(
        F.kll_merge_agg_double("_k", SKETCH).alias("_k"), F.sum("_n").alias("_n"), F.min("_least").alias("least"), F.max("_most").alias("most")
    )
    found = []
    for name, q in wanted.items():
        low = F.col("least") if q - SLACK <= 0 else F.kll_sketch_get_quantile_double("_k", F.lit(q - SLACK))
        high = F.col("most") if q + SLACK >= 1 else F.kll_sketch_get_quantile_double("_k", F.lit(q + SLACK))
        rank = (F.col("_n") - 1) * F.lit(float(q))
        found.append(F.struct(F.lit(name).alias("name"), rank.alias("rank"), low.alias("low"), high.alias("high")))
    return merged.select(*groups, "least", "most", F.explode(F.array(*found)).alias("_b")).select(*groups, "_b.*", "least", "most")


def _counted(rows: DataFrame, brackets: DataFrame, members: DataFrame, pieces: list[str], groups: list[str]) -> DataFrame:
    """Brackets with ``below`` and ``inside``: exact row counts, from counts per piece and interval between edges."""
    of_piece = brackets.join(members, groups).select(*pieces, F.explode(F.array("low", "high")).alias("_e"))
    edges = of_piece.groupBy(*pieces).agg(F.sort_array(F.collect_set("_e")).alias("_e"))  # two per group and rank
    under = F.size(F.filter("_e", lambda e: e < F.col("_v")))
    cells = rows.join(edges, pieces).select(*pieces, F.element_at("_e", F.when(under > 0, under)).alias("_above"), F.try_element_at("_e", under + 1).alias("_upto"), "_v")
    # a cell holds the values in (edge, next edge), or the values at the next edge itself
    at = F.coalesce(F.col("_upto") == F.col("_v"), F.lit(False))
    cells = cells.groupBy(*pieces, "_above", "_upto", at.alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    met = cells.join(members, pieces).join(brackets, groups)
    above, upto = F.col("_above"), F.col("_upto")
    below = F.when(F.col("_at"), upto < F.col("low")).otherwise(F.coalesce(upto <= F.col("low"), F.lit(False)))
    beyond = F.when(F.col("_at"), upto > F.col("high")).otherwise(F.coalesce(above >= F.col("high"), F.lit(False)))
    counted = met.groupBy(*groups, "name", "rank", "low", "high", "least", "most").agg(
        F.sum(F.when(below, F.col("_c")).otherwise(0)).alias("below"), F.sum(F.when(~below & ~beyond, F.col("_c")).otherwise(0)).alias("inside")
    )
    return staged(counted)


def _narrow(inside: DataFrame, by: list[str]) -> DataFrame:
    """Rows ``(by, rank, below, _v, _c)`` of the value ranges that hold the ranks, and the rows below them."""
    span = Window.partitionBy(*by)
    spread = inside.withColumns({"_lo": F.min("_v").over(span), "_hi": F.max("_v").over(span)})
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES), F.lit(RANGES - 1))
    ranged = spread.withColumn("_r", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(0)).cast("int")).drop("_lo", "_hi")
    counts = ranged.groupBy(*by, "_r").agg(F.sum("_c").alias("_n"), F.first("rank").alias("_rank"), F.first("below").alias("_b"))
    upto = Window.partitionBy(*by).orderBy("_r")  # at most RANGES rows
    counts = counts.withColumn("_to", F.col("_b") + F.sum("_n").over(upto)).withColumn("_from", F.col("_to") - F.col("_n"))
    kept = counts.where((F.ceil("_rank") >= F.col("_from")) & (F.floor("_rank") < F.col("_to")))
    first = kept.groupBy(*by).agg(F.min("_from").alias("_below"))
    return ranged.join(kept.select(*by, "_r"), [*by, "_r"]).join(first, by).withColumn("below", F.col("_below")).drop("_r", "_below")


def piece_quantiles(
    rows: DataFrame, pieces: Sequence[str], members: DataFrame, groups: Sequence[str], value: str, wanted: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles of groups of pieces, one row per group that has rows.

    ``rows`` hold the piece columns and the value (nulls do not count), ``members(groups, pieces)`` says which pieces form
    each group; a piece may be in several.  Names of pieces and groups must differ.  ``rows`` are read three times.
    """
    pieces, groups = list(pieces), list(groups)
    rows = rows.select(*pieces, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    members = members.select(*groups, *pieces).distinct()
    sketches = rows.groupBy(*pieces).agg(
        F.kll_sketch_agg_double("_v", SKETCH).alias("_k"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    brackets = _counted(rows, staged(_brackets(staged(sketches), members, pieces, groups, wanted)), members, pieces, groups)
    low_missed, high_missed = F.floor("rank") < F.col("below"), F.ceil("rank") >= F.col("below") + F.col("inside")
    if not brackets.where(low_missed | high_missed).isEmpty():
        opened = brackets.withColumns({"low": F.when(low_missed, F.col("least")).otherwise(F.col("low")), "high": F.when(high_missed, F.col("most")).otherwise(F.col("high"))})
        brackets = _counted(rows, opened.drop("below", "inside"), members, pieces, groups)

    # rows inside a bracket of a group that their piece belongs to, as counted values
    by = [*groups, "name"]
    columns = [*by, "rank", "below", "low", "high"]
    of_piece = brackets.join(members, groups).groupBy(*pieces).agg(F.collect_list(F.struct(*columns)).alias("_b"))
    hits = F.filter("_b", lambda b: F.col("_v").between(b["low"], b["high"]))
    inside = rows.join(of_piece, pieces).select("_v", F.explode(hits).alias("_h")).select("_h.*", "_v")
    inside = staged(inside.groupBy(*by, "rank", "below", "_v").agg(F.count(F.lit(1)).alias("_c")))
    for _ in range(64):  # a double has no more bits to tell values apart
        most = inside.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= RANKED:
            break
        inside = staged(_narrow(inside, by))

    last = F.col("below") + F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))  # 1-based rank of the last copy
    ranked = inside.withColumn("_to", last).withColumn("_from", F.col("_to") - F.col("_c"))

    def at(position: Column) -> Column:
        return F.max(F.when((position >= F.col("_from")) & (position < F.col("_to")), F.col("_v")))

    picked = ranked.groupBy(*by, "rank").agg(at(F.floor("rank")).alias("_lo"), at(F.ceil("rank")).alias("_hi"))
    values = picked.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("rank") - F.floor("rank")))
    return values.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == n, F.col("_q"))).alias(n) for n in wanted])

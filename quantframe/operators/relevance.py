"""Exact best matches by BM25 over an inverted index, without scoring what cannot reach the best ``k``.

The index is a table of postings (term, document, weight); a weight is what the term adds to the document's score.  Only
terms of the queries are indexed.  Each term has an upper bound, its largest weight, and a k-th weight: ``k`` documents
score at least that much, so a query's best k-th weight is a floor of its k-th score.  Terms whose bounds together stay
below the floor cannot lift a document to it alone; candidates come from the other terms only, and
only candidates are ranked.  Postings are summed up per query and document where they lie, so the work is that of the queries' own
postings: a candidate never meets all other terms that its document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.text import all_tokens
from quantframe.session import staged

K1, B = 1.2, 0.75
SCORE_DIGITS = 9
#: Terms of queries travel to the documents up to this many.
TRAVELLING_TERMS = 1 << 20


def postings(documents: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, key, weight`` of every wanted term in every document; statistics are those of all documents.

    ``terms(term)`` are distinct.  Null texts count as documents without words.
    """
    words = documents.select(key, F.coalesce(all_tokens(F.col(text)), F.array().cast("array<string>")).alias("_w"))
    n, mean = words.agg(F.count(F.lit(1)), F.avg(F.size("_w"))).first()
    small = terms.limit(TRAVELLING_TERMS + 1).count() <= TRAVELLING_TERMS
    spread = words.select(key, F.size("_w").alias("_length"), F.explode("_w").alias("term"))
    found = spread.join(F.broadcast(terms) if small else terms, "term")
    counted = staged(found.groupBy("term", key, "_length").agg(F.count(F.lit(1)).alias("_tf")))
    held = counted.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    rarity = F.log(1 + (F.lit(float(n or 0)) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    share = F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_length") / F.lit(float(mean or 1))))
    return counted.join(held, "term").select("term", key, (rarity * share).alias("weight"))


def needed_terms(wanted: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``query_id, term, needed``: which terms of each query must be read for candidates."""
    best = Window.partitionBy("term").orderBy(F.col("weight").desc())
    top = weights.select("term", "weight").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    bounds = top.groupBy("term").agg(F.max("weight").alias("_bound"), F.max(F.when(F.col("_n") == k, F.col("weight"))).alias("_kth"))
    of_query = Window.partitionBy("query_id")
    rising = of_query.orderBy("_bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    scored = wanted.join(bounds, "term").withColumns({"_floor": F.coalesce(F.max("_kth").over(of_query), F.lit(0.0)), "_upto": F.sum("_bound").over(rising)})
    return scored.select("query_id", "term", (F.col("_upto") >= F.col("_floor") * (1 - 1e-9)).alias("needed"))


def bm25(queries: DataFrame, documents: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` documents that score best for each query, among those that hold a term.

    ``queries(query_id, query_text)``.  Scores are rounded before ranking and ties go to the smaller key.
    """
    terms = F.explode(F.array_distinct(all_tokens(F.col("query_text")))).alias("term")
    wanted = staged(queries.select("query_id", terms))
    weights = staged(postings(documents, wanted.select("term").distinct(), key, text))
    needed = staged(needed_terms(wanted, weights, k))
    # a query meets the postings of its own terms only; a candidate is a document that holds a needed one of them
    asked = needed.where(F.col("query_id").isNotNull())
    few = asked.limit(TRAVELLING_TERMS + 1).count() <= TRAVELLING_TERMS
    # the postings of a document come together once, and what its queries make of them is summed up there
    held = weights.where(F.col(key).isNotNull()).repartition(key)
    named = held.join(F.broadcast(asked) if few else asked, "term")
    met = named.groupBy("query_id", key).agg(F.sum("weight").alias("_sum"), F.max("needed").alias("_candidate"))
    scored = met.where("_candidate").select("query_id", key, F.round("_sum", SCORE_DIGITS).alias("score"))
    order: list[Column] = [F.col("score").desc(), F.col(key).asc()]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", key, "score", "rank")

"""Exact cosine top-k search inside namespaces, and what is built on it.

Three plans, chosen by checked sizes:

* few queries: the query matrix travels to every corpus partition,
* few corpus rows (prototypes, a small cache): the corpus matrix travels to the query partitions,
* both large: the corpus is grouped around pivots, and a query meets only the groups that the triangle inequality
  cannot rule out, in bounded cogroups.

Each task keeps its best ``k`` rows per query, so what is shuffled is ``k`` rows per query and
task, never the score matrix.  Scores are rounded before ranking and ties go to the smaller id,
which makes the ranking independent of the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.text import has_pii, is_transactional, pair_score
from quantframe.operators.tables import last_write_wins
from quantframe.session import staged

PACK_ROWS = 4096  # rows of the side that travels
BLOCK_QUERIES, BLOCK_CORPUS = 2048, 16384
SCORE_DIGITS = 9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(rows), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, id, score)`` of the top ``k`` of each row of scores by (score desc, id asc), rows in order."""
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero(scores >= floor[:, None])
    else:
        row, column = np.nonzero(np.ones(scores.shape, bool))
    return _first_of_rows(row, ids[column], scores[row, column], k)


def _first_of_rows(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[place < k], scores[place < k]


def _score(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    return np.round(_unit(queries) @ _unit(corpus).T, SCORE_DIGITS)


def _small(df: DataFrame) -> bool:
    return df.select(F.lit(1)).limit(PACK_ROWS + 1).count() <= PACK_ROWS


def _schema(queries: DataFrame, corpus: DataFrame) -> str:
    kind = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {kind}, namespace string, id {corpus.schema['id'].dataType.simpleString()}, score double"


def _group_rows(frame: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {
        ns: (part.iloc[:, 1].to_numpy(), np.stack(part.iloc[:, 2].to_numpy()).astype("float64"))
        for ns, part in frame.groupby("namespace", sort=False)
    }


def _by_packed_queries(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    packed = _group_rows(queries.select("namespace", "query_id", "vector").toPandas())
    schema = _schema(queries, corpus)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            spaces = batch.column("namespace").to_numpy(zero_copy_only=False)
            ids, vectors = batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("embedding"))
            for ns in set(spaces) & set(packed):
                rows = spaces == ns
                found = _best(ids[rows], _score(packed[ns][1], vectors[rows]), k)
                if ns in held:
                    found = _first_of_rows(*(np.concatenate(pair) for pair in zip(held[ns], found)), k)
                held[ns] = found
        for ns, (row, ids, scores) in held.items():
            yield pa.RecordBatch.from_pydict({"query_id": packed[ns][0][row], "namespace": [ns] * len(row), "id": ids, "score": scores})

    return _rank(corpus.select("namespace", "id", "embedding").mapInArrow(scan, schema), k)


def _by_packed_corpus(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    packed = _group_rows(corpus.select("namespace", "id", "embedding").toPandas())
    schema = _schema(queries, corpus)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch.column("namespace").to_numpy(zero_copy_only=False)
            names, vectors = batch.column("query_id").to_numpy(zero_copy_only=False), _matrix(batch.column("vector"))
            for ns in set(spaces) & set(packed):
                rows = spaces == ns
                ids, matrix = packed[ns]
                row, found, scores = _best(ids, _score(vectors[rows], matrix), k)
                yield pa.RecordBatch.from_pydict({"query_id": names[rows][row], "namespace": [ns] * len(row), "id": found, "score": scores})

    # every query meets the whole corpus in one place, so its rows are already its top k
    return _rank(queries.select("namespace", "query_id", "vector").mapInArrow(scan, schema), k)


#: Groups of the corpus around pivots; a larger corpus has larger groups, cut into blocks.
PIVOTS = 4096
#: By so much a group's best possible score may fall short of a found one and still be visited: rounding.
CLOSE = 1e-8


class _Pivots:
    """Pivots of each namespace; each has the smallest and largest distance of its group's rows and their number."""

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.vectors = {ns: _unit(v) for ns, v in vectors.items()}
        self.near: dict[str, np.ndarray] = {}
        self.far: dict[str, np.ndarray] = {}
        self.rows: dict[str, np.ndarray] = {}

    def distances(self, ns: str, unit: np.ndarray) -> np.ndarray:
        """Chord lengths on the unit sphere, a metric; the null vector counts as orthogonal to all."""
        return np.sqrt(np.maximum(2 - 2 * (unit @ self.vectors[ns].T), 0))

    def measured(self, groups: list) -> None:
        for ns, vectors in self.vectors.items():
            n = len(vectors)
            self.near[ns], self.far[ns], self.rows[ns] = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        for g in groups:
            self.near[g.namespace][g.pivot], self.far[g.namespace][g.pivot], self.rows[g.namespace][g.pivot] = g.near, g.far, g.rows

    def best_scores(self, ns: str, unit: np.ndarray) -> np.ndarray:
        """Highest cosine that a row of each group can have with each query, by the triangle inequality."""
        d = self.distances(ns, unit)
        least = np.maximum(np.maximum(d - self.far[ns], self.near[ns] - d), 0)
        best = 1 - least**2 / 2
        best[~unit.any(axis=1)] = 0  # a null query scores 0 everywhere
        best[:, self.rows[ns] == 0] = -np.inf
        return best


def _assigned(corpus: DataFrame, pivots: _Pivots) -> DataFrame:
    """Corpus rows with their nearest pivot and the distance to it; null vectors reach from 0 to 2, so all visit them."""
    schema = f"namespace string, id {corpus.schema['id'].dataType.simpleString()}, embedding array<float>, pivot int, near double, far double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch.column("namespace").to_numpy(zero_copy_only=False)
            pivot, near, far = np.zeros(len(spaces), np.int32), np.zeros(len(spaces)), np.full(len(spaces), 2.0)
            units = _unit(_matrix(batch.column("embedding")))
            for ns in set(spaces):
                rows = np.flatnonzero(spaces == ns)
                d = pivots.distances(ns, units[rows])
                pivot[rows] = d.argmin(axis=1)
                least, real = d.min(axis=1), units[rows].any(axis=1)
                near[rows], far[rows] = np.where(real, least, 0.0), np.where(real, least, 2.0)
            columns = {"namespace": batch.column("namespace"), "id": batch.column("id"), "embedding": batch.column("embedding").cast(pa.list_(pa.float32()))}
            yield pa.record_batch({**columns, "pivot": pivot, "near": near, "far": far})

    return corpus.select("namespace", "id", "embedding").mapInArrow(assign, schema)


def _visits(queries: DataFrame, pivots: _Pivots, first: bool) -> DataFrame:
    """``query_id, namespace, vector, pivot``: the most promising group of each query, or all others that may still matter.

    The others need ``kth``, the query's k-th score so far (null with fewer rows).
    """
    kind = queries.schema["query_id"].dataType.simpleString()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch.column("namespace").to_numpy(zero_copy_only=False)
            units = _unit(_matrix(batch.column("vector")))
            for ns in set(spaces) & set(pivots.vectors):
                rows = np.flatnonzero(spaces == ns)
                best = pivots.best_scores(ns, units[rows])
                nearest = np.zeros(best.shape, bool)
                nearest[np.arange(len(rows)), best.argmax(axis=1)] = True
                if first:
                    chosen = nearest
                else:
                    kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)[rows]
                    chosen = ~nearest & (best >= np.where(np.isnan(kth), -2.0, kth - CLOSE)[:, None])
                row, pivot = np.nonzero(chosen)
                taken = pa.array(rows[row])
                yield pa.record_batch(
                    {"query_id": batch.column("query_id").take(taken), "namespace": batch.column("namespace").take(taken), "vector": batch.column("vector").take(taken), "pivot": pa.array(pivot, pa.int32())}
                )

    vector = queries.schema["vector"].dataType.simpleString()
    return queries.mapInArrow(visit, f"query_id {kind}, namespace string, vector {vector}, pivot int")


def _by_pivots(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    schema = _schema(queries, corpus)
    queries = queries.select("query_id", "namespace", "vector").where(F.col("vector").isNotNull())
    sizes = corpus.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.ceil(F.col("n") / F.lit(BLOCK_CORPUS)), F.lit(PIVOTS))
    # pivots are the rows with the smallest hashes, at most PIVOTS a namespace
    drawn = Window.partitionBy("namespace").orderBy(F.xxhash64("id"), "id")
    picked = corpus.select("namespace", "id", "embedding").withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= PIVOTS)
    picked = picked.join(sizes, "namespace").where(F.col("_r") <= share)
    pivots = _Pivots({ns: rows[1] for ns, rows in _group_rows(picked.select("namespace", "id", "embedding").toPandas()).items()})
    held = staged(_assigned(corpus, pivots))
    groups = held.groupBy("namespace", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.count(F.lit(1)).alias("rows"))
    pivots.measured(groups.collect())  # one row a pivot
    blocks = groups.select("namespace", "pivot", F.ceil(F.col("rows") / F.lit(BLOCK_CORPUS)).cast("int").alias("_nc"))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        scores = _score(_matrix(q.column("vector")), _matrix(c.column("embedding"))) if len(q) and len(c) else np.empty((0, 0))
        row, ids, scores = _best(c.column("id").to_numpy(), scores, k)
        names = q.column("query_id").take(pa.array(row))
        space = (q if len(q) else c).column("namespace")[0]
        return pa.table({"query_id": names, "namespace": pa.array([space.as_py()] * len(row), pa.string()), "id": ids, "score": scores})

    def search(visits: DataFrame) -> DataFrame:
        visits = staged(visits)
        asked = visits.groupBy("namespace", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUERIES)).cast("int").alias("_nq"))
        both = staged(asked.join(blocks, ["namespace", "pivot"]))
        left = visits.join(both, ["namespace", "pivot"]).withColumns(
            {"_q": F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int"), "_c": F.explode(F.sequence(F.lit(0), F.col("_nc") - 1))}
        )
        right = held.drop("near", "far").join(both, ["namespace", "pivot"]).withColumns(
            {"_c": F.pmod(F.xxhash64("id"), F.col("_nc")).cast("int"), "_q": F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))}
        )
        keys = ["namespace", "pivot", "_q", "_c"]
        return left.drop("_nq", "_nc").groupBy(*keys).cogroup(right.drop("_nq", "_nc").groupBy(*keys)).applyInArrow(meet, schema)

    nearest = staged(_rank(search(_visits(queries, pivots, True)), k).drop("rank"))
    floor = nearest.groupBy("query_id", "namespace").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    others = _visits(queries.join(floor, ["query_id", "namespace"], "left").select("query_id", "namespace", "vector", "kth"), pivots, False)
    return _rank(nearest.unionByName(search(others)), k)


def _rank(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id", "namespace").orderBy(F.col("score").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int, plan: str | None = None) -> DataFrame:
    """(query_id, namespace, id, score, rank) of the ``k`` nearest rows of each query's namespace.

    ``queries`` has query_id, namespace, vector; ``corpus`` has namespace, id, embedding.
    """
    corpus = corpus.filter(F.col("embedding").isNotNull())
    if plan is None:
        plan = "queries" if _small(queries) else "corpus" if _small(corpus) else "pivots"
    return {"queries": _by_packed_queries, "corpus": _by_packed_corpus, "pivots": _by_pivots}[plan](queries, corpus, k)


DAY = 86400
NEWS_TOP, NEWS_BACK_DAYS = 15, 4


def knn_filtered(queries: DataFrame, corpus: DataFrame, day_epoch: float, k: int = NEWS_TOP) -> DataFrame:
    """Top ``k`` among news of the last days, then only those naming the query's ticker."""
    recent = corpus.filter(F.col("published_at").between(day_epoch - NEWS_BACK_DAYS * DAY, day_epoch + DAY))
    found = knn(queries, recent, k).join(queries.select("query_id", "ticker"), "query_id")
    matched = found.join(recent.drop("embedding"), ["namespace", "id"])
    return matched.filter(F.contains(F.col("ticker_principal"), F.col("ticker")))


def latest_feed(query: DataFrame, corpus: DataFrame, limit: int = 10) -> DataFrame:
    """Nearest ``limit`` news, newest first, with defaults for missing metadata."""
    found = knn(query, corpus, limit).join(corpus.drop("embedding"), ["namespace", "id"])
    feed = found.select(
        "id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("sentiment", F.lit("unknown")).alias("sentiment"),
        F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment_score"),
        F.coalesce("ticker_principal", F.lit("none")).alias("ticker_principal"),
        F.coalesce("tickers_relacionados", F.lit("none")).alias("tickers_relacionados"),
        F.coalesce("published_at", F.lit(0.0)).alias("published_at"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("url", F.lit("")).alias("url"),
    )
    return feed.orderBy(F.col("published_at").desc(), F.col("id").asc())


NO_CONTEXT = "(no matching news)"
GLOBAL_NAMESPACE = "fin_news_v1"
SOURCE_TOP, CONTEXT_TOP = 10, 4


def union_distinct_by_id(found: DataFrame) -> DataFrame:
    """One row per (query, id): the first by source order, then rank."""
    rest = [c for c in found.columns if c not in ("query_id", "id")]
    return (
        found.groupBy("query_id", "id")
        .agg(F.min_by(F.struct(*rest), F.struct("source_order", "rank")).alias("_r"))
        .select("query_id", "id", "_r.*")
    )


def context_candidates(queries: DataFrame, corpus: DataFrame, k: int = SOURCE_TOP) -> DataFrame:
    """Nearest rows of the global and of the query's tenant namespace, without repeats."""
    spaces = F.array(F.lit(GLOBAL_NAMESPACE), F.concat(F.lit("tenant_"), F.col("tenant_id")))
    asked = queries.withColumn("namespace", F.explode(spaces)).select("query_id", "namespace", "vector")
    found = knn(asked, corpus, k).withColumn(
        "source_order", F.when(F.col("namespace") == GLOBAL_NAMESPACE, 0).otherwise(1)
    )
    return union_distinct_by_id(found)


def rag_context(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Context text per query: candidates reranked by pair score, best four joined."""
    found = context_candidates(queries, corpus)
    texts = found.join(corpus.select("namespace", "id", "text"), ["namespace", "id"])
    scored = texts.join(queries.select("query_id", "query_text"), "query_id").withColumn(
        "rerank_score", pair_score(F.col("query_text"), F.col("text"))
    )
    # stable sort: equal scores keep the candidates' order
    window = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "source_order", "rank")
    top = scored.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= CONTEXT_TOP)
    joined = top.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]), "\n- "
        ).alias("context"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id",
        F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"),
        F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"),
    )


CACHE_NAMESPACE = "semantic_cache_v1"
CACHE_DISTANCE, CACHE_TTL = 0.15, 300


def semantic_cache_lookup(queries: DataFrame, cache: DataFrame, now: Column, ttl: int = CACHE_TTL) -> DataFrame:
    """Cached response of each query, if its single nearest entry is close and fresh enough.

    Transactional queries and queries with personal data never look.  An expired nearest entry
    is a miss even if a fresh one is second.
    """
    bypass = is_transactional(F.col("query_text")) | has_pii(F.col("query_text"))
    # the masking patterns are the costly part, so they run once over each text
    flagged = staged(queries.select("query_id", "vector", bypass.alias("bypass")))
    asked = flagged.filter(~F.col("bypass")).withColumn("namespace", F.lit(CACHE_NAMESPACE))
    nearest = knn(asked, cache, 1).join(cache.select("namespace", "id", "response", "timestamp"), ["namespace", "id"])
    close = (F.lit(1.0) - F.col("score") < CACHE_DISTANCE) & (now - F.col("timestamp") <= ttl)
    hits = nearest.select("query_id", F.when(close, F.col("response")).alias("response"))
    return flagged.join(hits, "query_id", "left").select(
        "query_id", "bypass", F.col("response").isNotNull().alias("is_cached"), "response"
    )


def semantic_cache_save(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Write answered queries (query_text, response, embedding, timestamp), keyed by their text."""
    rows = entries.select(
        F.lit(CACHE_NAMESPACE).alias("namespace"), F.md5("query_text").alias("id"), "embedding", "response", "timestamp"
    )
    return last_write_wins(cache.unionByName(rows), ["namespace", "id"], ["timestamp"])


def route_complexity(queries: DataFrame, prototypes: DataFrame) -> DataFrame:
    """'complex' where the nearest complex prototype beats the nearest simple one, else 'simple'."""
    classes = F.explode(F.array(F.lit("complex"), F.lit("simple")))
    asked = queries.select("query_id", "vector").withColumn("namespace", classes)
    best = knn(asked, prototypes, 1).groupBy("query_id").agg(
        F.max(F.when(F.col("namespace") == "complex", F.col("score"))).alias("complex_score"),
        F.max(F.when(F.col("namespace") == "simple", F.col("score"))).alias("simple_score"),
    )
    return best.withColumn(
        "complexity", F.when(F.col("complex_score") > F.col("simple_score"), "complex").otherwise("simple")
    )


def namespace_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_vectors"))

"""Near-duplicate vectors by NN-descent.

0.  Equal vectors are one, with a count: copies would fill each other's lists.
1.  A first graph: vectors are sorted several times along random sign codes, cut into chunks, and each keeps
    its nearest of the chunk.
2.  Refinement: the neighbours of a vector, in both directions, are compared with each other (neighbours of
    neighbours); a pair that is closer than what either end has enters the lists.
3.  A sample of vectors is compared with all of them, in blocks; while the graph misses too many of their
    links, lists are made longer and refined further.
4.  Edges above the threshold connect vectors into components.  A list that is full of such edges is
    saturated: it may lack links, also to another component, and the other end lacks them only where its list
    is saturated too.  All saturated lists are therefore held against each other in blocks, and where the
    sample still misses links after the last round all vectors are; what is found joins components.
5.  Every list is enlarged to its component, and the links are counted block by block in double precision
    without listing the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantframe.llm.graph import components
from quantframe.session import staged

#: Vectors compared with each other at a time.
CHUNK = 512
#: Tasks that share the copies of one vector.
SALTS = 32
EDGES = "a long, b long, sim double"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(column: pd.Series) -> pd.Series:
    """Vectors of length one in double precision; null where a vector is null, empty, zero or not finite."""

    def one(v):
        if v is None or len(v) == 0:
            return None
        x = np.array([np.nan if c is None else c for c in v], np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            return None
        x = x / top
        return x / np.sqrt((x * x).sum())

    return column.map(one)


def _key(column: pd.Series) -> pd.Series:
    """Full hash of a vector's bytes."""
    return column.map(lambda v: None if v is None else hashlib.sha256((np.asarray(v) + 0.0).tobytes()).digest())


def _coded(trees: int, bits: int, dim: int):
    """Each vector once per tree with its sign code and a last projection that breaks ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(11).standard_normal((trees, bits + 1, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            for tree in range(trees):
                p = x @ planes[tree].T
                code = ((p[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64)
                yield pa.record_batch(
                    {"tree": pa.array(np.full(len(x), tree, np.int32)), "code": pa.array(code), "last": pa.array(p[:, bits]), "vec_id": batch.column(0), "unit": batch.column(1)}
                )

    return run


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of every vector among those given."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2.0)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(ids), 0), int)
    a = np.repeat(ids, top.shape[1])
    return pa.record_batch({"a": pa.array(a), "b": pa.array(ids[top.ravel()]), "sim": pa.array(sims[np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()])})


def _chunked(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.empty(0, np.int64), np.empty((0, dim))
        for batch in batches:
            ids, rows = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([rows, _matrix(batch.column(1), dim)])
            while len(ids) >= 2 * CHUNK:
                yield _nearest(ids[:CHUNK], rows[:CHUNK], k)
                ids, rows = ids[CHUNK // 2 :], rows[CHUNK // 2 :]  # chunks overlap by half
        for start in range(0, max(len(ids), 1), CHUNK):
            if len(ids) - start > 1:
                yield _nearest(ids[start : start + CHUNK], rows[start : start + CHUNK], k)

    return run


def _joined(dim: int, width: int):
    """Compare the neighbours of each vector with each other; rows come sorted by the vector they belong to."""

    def emit(owner: np.ndarray, ids: np.ndarray, least: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(owner)) + 1
        starts, sizes = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(owner)]]))
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(starts), 2048):
            s, n = starts[at : at + 2048], sizes[at : at + 2048]
            place = s[:, None] + np.minimum(np.arange(width), n[:, None] - 1)
            real = np.arange(width) < n[:, None]
            sims = np.einsum("gid,gjd->gij", x[place], x[place], optimize=True)
            who, low = ids[place], least[place]
            i, j = np.triu_indices(width, 1)
            new = real[:, i] & real[:, j] & (who[:, i] != who[:, j]) & (sims[:, i, j] > np.minimum(low[:, i], low[:, j]))
            out[0].append(who[:, i][new])
            out[1].append(who[:, j][new])
            out[2].append(sims[:, i, j][new])
        a, b, sim = (np.concatenate(c) for c in out)
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b), "sim": pa.array(sim)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (*(batch.column(i).to_numpy() for i in range(3)), _matrix(batch.column(3), dim))
            now = now if kept is None else tuple(np.concatenate([o, n]) for o, n in zip(kept, now))
            whole = int(np.searchsorted(now[0], now[0][-1]))  # the last vector's rows may go on
            if whole:
                yield emit(*(c[:whole] for c in now))
            kept = tuple(c[whole:] for c in now)
        if kept is not None:
            yield emit(*kept)

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k closest edges of every vector, both directions of an edge counting."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    both = both.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _refined(graph: DataFrame, units: DataFrame, k: int, dim: int) -> DataFrame:
    """One round of NN-descent."""
    least = graph.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least"))
    least = least.select("a", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least"))
    known = staged(units.join(least.withColumnRenamed("a", "vec_id"), "vec_id", "left").fillna(-2.0, ["least"]))
    near = graph.select(F.col("a").alias("owner"), F.col("b").alias("vec_id")).unionByName(units.select(F.col("vec_id").alias("owner"), "vec_id"))
    local = near.join(known, "vec_id").select("owner", "vec_id", "least", "unit")
    n = max(1, int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fresh = local.repartition(n, "owner").sortWithinPartitions("owner").mapInArrow(_joined(dim, k + 1), EDGES)
    return staged(_best(graph.unionByName(fresh), k))


def _sampled_links(sample: list, threshold: float, dim: int):
    """Links of a given small set of vectors with every row."""
    ids, x = np.array([r[0] for r in sample], np.int64), np.array([r[1] for r in sample], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                other = batch.column(0).to_numpy()
                i, j = np.nonzero(_matrix(batch.column(1), dim) @ x.T >= threshold)
                keep = other[i] != ids[j]
                yield pa.record_batch({"a": pa.array(ids[j][keep]), "b": pa.array(other[i][keep])})

    return run


def _across(threshold: float):
    """Components that a link between two blocks joins."""

    def run(group: pa.Table) -> pa.Table:
        left, right = group.column("side").to_numpy() <= 1, group.column("side").to_numpy() >= 1
        x, whole = _matrix(group.column("unit"), len(group.column("unit")[0])), group.column("component").to_numpy()
        near = (x[left] @ x[right].T >= threshold) & (whole[left][:, None] != whole[right][None, :])
        i, j = np.nonzero(near)
        a, b = np.unique(np.stack([whole[left][i], whole[right][j]]), axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _count_links(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        left, right = group.column("side").to_numpy() <= 1, group.column("side").to_numpy() >= 1
        dim = len(group.column("unit")[0])
        ids, x, copies = group.column("vec_id").to_numpy(), _matrix(group.column("unit"), dim), group.column("copies").to_numpy()
        near = x[left] @ x[right].T >= threshold
        inside = bool((left & right).any())  # a block with itself: every pair is seen from both ends
        found = pa.array(np.concatenate([ids[left], np.empty(0, np.int64) if inside else ids[right]]))
        # a vector links with its own copies, not with itself
        own = (near & (ids[left][:, None] == ids[right][None, :])).sum(1)
        n = np.concatenate([near @ copies[right] - own, np.empty(0, np.int64) if inside else near.T @ copies[left]])
        return pa.table({"vec_id": found, "n": pa.array(n.astype(np.int64))})

    return run


def _paired(placed: DataFrame) -> DataFrame:
    """Rows of ``placed`` once for every block that theirs meets; a pair of blocks is ``i``, ``j``."""
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    columns = ("component", "vec_id", "unit", "copies")
    pairs = placed.select(*columns, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2)
    return pairs.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), *columns)


def _links_of_dim(units: DataFrame, dim: int, threshold: float, k: int, trees: int, rounds: int, audit: int, recall: float) -> DataFrame:
    """``(vec_id, n_links, component)`` of different vectors of one dimension that link with another or with copies."""
    spark = units.sparkSession
    total = units.count()
    bits = max(1, int(np.ceil(np.log2(max(total / CHUNK, 2)))))
    coded = units.select("vec_id", "unit").mapInArrow(_coded(trees, bits, dim), "tree int, code long, last double, vec_id long, unit array<double>")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("tree", "code", "last", "vec_id")
    coded = coded.repartitionByRange(n, *order).sortWithinPartitions(*order)
    graph = staged(_best(coded.select("vec_id", "unit").mapInArrow(_chunked(k, dim), EDGES), k))
    sample = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(audit).select("vec_id", "unit").collect()
    true = staged(units.select("vec_id", "unit").mapInArrow(_sampled_links(sample, threshold, dim), "a long, b long"))
    sought = true.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    for turn in range(rounds):
        graph = _refined(graph, units, k, dim)
        links = graph.where(F.col("sim") >= threshold).select("a", "b")
        group = staged(components(links))
        ends = true.join(group.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(group.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
        # each sampled vector counts alike, however many links it has
        shares = ends.groupBy("a").agg(F.sum(F.when(F.col("x") == F.col("y"), 1).otherwise(0)).alias("met"))
        shares = sought.join(shares, "a", "left").agg(F.avg(F.coalesce("met", F.lit(0)) / F.col("n"))).first()[0]
        met, full = shares is None or shares >= recall, k
        if turn and met:
            break
        k = 2 * k if turn else k  # the audit failed: longer lists
    saturated = links.groupBy("a").count().where(F.col("count") >= full).select(F.col("a").alias("vec_id"))
    rest = units.join(saturated, "vec_id") if met else units
    rest = staged(rest.join(group.withColumnRenamed("id", "vec_id"), "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id")))
    many = rest.withColumn("blocks", F.lit(int(np.ceil(max(rest.count(), 1) / (2 * CHUNK)))))
    joined = _paired(many).groupBy("i", "j").applyInArrow(_across(threshold), "a long, b long")
    # what the audit itself found belongs to the graph too, and so do copies
    copied = units.where("copies > 1").select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"))
    group = staged(components(links.unionByName(true).unionByName(joined).unionByName(copied)))
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = group.join(sizes, "component").join(units, group["id"] == units["vec_id"])
    placed = placed.withColumn("blocks", F.ceil(F.col("members") / F.lit(2 * CHUNK)).cast("int"))
    counted = _paired(placed).groupBy("component", "i", "j").applyInArrow(_count_links(threshold), "vec_id long, n long")
    counted = counted.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return counted.join(group.withColumnRenamed("id", "vec_id"), "vec_id").select("vec_id", "n_links", "component")


def vector_links(
    vectors: DataFrame, threshold: float = 0.9, k: int = 8, trees: int = 12, rounds: int = 6, audit: int = 256, recall: float = 0.99
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector of ``vectors(vec_id, embedding)``.

    ``n_links`` counts the other vectors with a cosine of at least ``threshold`` (double precision),
    ``component_id`` is the smallest vec_id that links lead to.  Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, and so do vectors of different dimensions.  A repeated vec_id is
    one vector (its smallest embedding); a null vec_id links with nothing and keeps a row of its own.
    ``audit`` vectors, those with the smallest hash of vec_id, are held against all to measure ``recall``.
    Other columns are ignored.
    """
    unit = F.pandas_udf(_unit, "array<double>")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    once = named.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    key = F.pandas_udf(_key, "binary")
    units = once.select("vec_id", unit("embedding").alias("unit"))
    units = staged(units.withColumn("dim", F.size("unit")).withColumn("key", key("unit")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))))
    firsts = units.where("unit is not null").groupBy("key", "dim").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    firsts = staged(units.select("vec_id", "unit", "key", "salt").join(firsts.select("vec_id", "dim", "copies"), "vec_id"))
    found = None
    for row in firsts.groupBy("dim").agg(F.sum("copies").alias("n")).where("n > 1").select("dim").collect():  # a row per dimension
        part = firsts.where(F.col("dim") == row[0]).select("vec_id", "unit", "copies")
        part = _links_of_dim(part, row[0], threshold, k, trees, rounds, audit, recall)
        found = part if found is None else found.unionByName(part)
    every = units.select("vec_id", "key", "salt")
    if found is None:
        every = every.withColumns({"n_links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    else:
        salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array("salt"))
        found = found.join(firsts, "vec_id").select("key", F.explode(salts).alias("salt"), "n_links", "component")
        every = every.join(found, ["key", "salt"], "left")
    every = every.unionByName(named.where("vec_id is null").select("vec_id"), allowMissingColumns=True)
    out = every.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Rows are dealt into blocks by a hash of their id, whatever their label; the stated anchors are dealt into blocks as
well, and every pair of blocks meets in one task.  There each dimension of the candidates is sorted once.  An anchor
reads the lists in rounds, from the top where its own component is positive and from the bottom where it is negative
(sorted access); a row met for the first time is scored as a whole (random access, an integer inner product).  The
threshold is the anchor's product with the values last read: no unread row can score more.

1.  Positives: lists of the anchor's own label, until the threshold is strictly below the k-th score.
2.  Negatives: lists of all rows, own label left out.  Each positive score opens a window of admitted scores, and reading
    goes on until the threshold is strictly below every window's k-th score, or below the window itself.

A task returns at most ``k`` rows per anchor and window; the best of all tasks are taken by rank.  A list that is read
to its end ends the search, so the result is exact for every input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.session import staged

#: Rows of a block on either side.
CANDIDATES, ANCHORS = 1 << 14, 1 << 13
#: Rows read from each list in the first round; each further round reads twice as many.
FIRST_DEPTH = 16
SCALE = 256
#: Kinds of number for the products, each with the size up to which it holds every whole number.
KINDS = ((np.float32, float(1 << 24)), (np.float64, float(1 << 53)), (object, float("inf")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Whole-number rows of one width, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the smallest kind that holds every product and sum exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    kind = next(kind for kind, limit in KINDS if most < limit)
    return a.astype(kind), b.astype(kind)


class Lists:
    """Rows of a block, sorted once per dimension, for anchor-signed sorted access."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)  # ascending; a negative component reads from here

    def search(self, anchor: np.ndarray, skip: np.ndarray, done) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, scores)`` of the rows read until ``done(scores, threshold)``; ``skip`` marks rows to leave out."""
        n, down, up = len(self.ids), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        used, order = np.concatenate([up, down]), self.order
        unseen, fresh = ~skip, np.zeros(n, bool)
        ids, scores = np.empty(0, np.int64), np.empty(0, anchor.dtype)
        start, step = 0, FIRST_DEPTH
        while start < n:
            stop = min(n, start + step) if len(used) else n
            fresh[order[start:stop][:, up]] = True
            fresh[order[n - stop : n - start][:, down]] = True
            met = np.flatnonzero(fresh & unseen) if len(used) else np.flatnonzero(unseen)
            unseen[met] = False
            ids, scores = np.concatenate([ids, self.ids[met]]), np.concatenate([scores, self.rows[met] @ anchor])
            start, step = stop, step * 2
            if start < n:
                last = np.concatenate([order[stop - 1, up], order[n - stop, down]])
                if done(scores, (self.rows[last, used] * anchor[used]).sum()):
                    break
        return ids, scores


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by (score descending, id ascending)."""
    return np.lexsort((ids, -scores))[:k]


def _kth(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k]


def _positives(k: int):
    """Best ``k`` rows of the anchor's label in this pair of blocks."""

    def search(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        labels = rows.column("label").to_numpy()
        own = anchors.column("label").to_numpy()
        for label in np.unique(own):
            part = rows.filter(pa.array(labels == label))
            if not part.num_rows:
                continue
            group = anchors.filter(pa.array(own == label))
            names, vectors, lists = _sides(group, part)
            done = lambda scores, t: len(scores) >= k and t < _kth(scores, k)
            for name, vector in zip(names, vectors, strict=True):
                ids, scores = lists.search(vector, lists.ids == name, done)
                best = _first(ids, scores, k)
                yield name, 0, ids[best], scores[best]

    return search


def _negatives(k: int, low: int, high: int):
    """First ``k`` rows of another label in each of the anchor's windows, in this pair of blocks."""

    def search(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        names, vectors, lists = _sides(anchors, rows)
        own, windows = anchors.column("label").to_numpy(), anchors.column("windows").to_pylist()
        for name, label, vector, opened in zip(names, own, vectors, windows, strict=True):
            inside = lambda s, w: (low * w <= 100 * s) & (100 * s <= high * w)
            # a window whose ends have changed places admits nothing
            opened = [w for w in opened if low * w <= high * w]

            def done(scores, t, opened=opened, inside=inside):
                for w in opened:
                    if 100 * t < low * w:
                        continue
                    found = scores[inside(scores, w)]
                    if len(found) < k or t >= _kth(found, k):
                        return False
                return True

            if opened:
                ids, scores = lists.search(vector, lists.labels == label, done)
                for w in opened:
                    within = np.flatnonzero(inside(scores, w))
                    best = within[_first(ids[within], scores[within], k)]
                    yield name, w, ids[best], scores[best]

    return search


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, Lists]:
    width = max(pc.max(pc.list_value_length(t.column("vector"))).as_py() for t in (anchors, rows))
    a, r = _comparable(_matrix(anchors.column("vector"), width), _matrix(rows.column("vector"), width))
    return anchors.column("vec_id").to_numpy(), a, Lists(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), r)


def _meet(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], search) -> DataFrame:
    """``(anchor_id, opened, vec_id, score)`` of every pair of blocks."""
    left, right = sizes
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # names of their own, as both sides come from one table
    a = anchors.withColumn("ab", deal(left)).withColumn("rb", every(right))
    a = a.select(*[F.col(c).alias(f"anchor_{c}") for c in a.columns])
    r = rows.withColumn("rb", deal(right)).withColumn("ab", every(left))

    def task(one: pa.Table, other: pa.Table) -> pa.Table:
        one = one.rename_columns([c.removeprefix("anchor_") for c in one.column_names])
        found = list(search(one, other)) if one.num_rows and other.num_rows else []
        counts = [len(f[2]) for f in found]
        many = lambda i: np.repeat(np.array([f[i] for f in found], np.int64), counts)
        joined = lambda i: np.concatenate([np.empty(0, np.int64), *[f[i].astype(np.int64) for f in found]])
        return pa.table({"anchor_id": many(0), "opened": many(1), "vec_id": joined(2), "score": joined(3)})

    met = a.groupBy("anchor_ab", "anchor_rb").cogroup(r.groupBy("ab", "rb"))
    return met.applyInArrow(task, "anchor_id long, opened long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "opened").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_numbers(embedding: Column) -> Column:
    """Components as ``floor(256 * x)``; null where a component is null or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def hard_negatives(rows: DataFrame, anchors: Column, k_positive: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows(vec_id, label, vector)`` hold whole numbers.  The anchors' positives are the first ``k_positive`` other rows of
    their label; each opens a window of scores from ``low`` to ``high`` hundredths of its own, of which the first ``k``
    rows of other labels are returned.  Order: score descending, vec_id ascending.  Rows with a null take no part; one
    row stands for a repeated vec_id (the smallest by label and vector).  A shorter vector counts as filled up with
    zeros.  Scores beyond 64 bits are an error.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector").dropna()
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    rows = staged(rows.withColumn("asks", anchors))
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks = (max(1, -(-asking // ANCHORS)), max(1, -(-n // CANDIDATES)))
    asked, rows = rows.where("asks").drop("asks"), rows.drop("asks")
    positives = staged(_ranked(_meet(asked, rows, blocks, _positives(k_positive)), k_positive).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("opened")))
    windows = positives.groupBy("anchor_id").agg(F.collect_set("opened").alias("windows"))  # at most k_positive each
    asked = asked.join(windows, asked["vec_id"] == windows["anchor_id"]).drop("anchor_id")
    found = _ranked(_meet(asked, rows, blocks, _negatives(k, low, high)), k)
    return positives.join(found, ["anchor_id", "opened"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("opened").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def embedding_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings(vec_id, embedding, label)``; anchors are the rows whose vec_id 100 divides.

    Where 7 divides vec_id, the label first becomes (label + 1) % 10.  See ``hard_negatives`` and ``whole_numbers`` for
    nulls, ties and repeated rows; other columns do not enter; an empty table gives an empty result.
    """
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", label.alias("label"), whole_numbers(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, F.pmod("vec_id", F.lit(100)) == 0)

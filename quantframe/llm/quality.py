"""Quality by positive-unlabelled learning: a linear classifier that minimises the non-negative unbiased risk.

Trusted positives are the documents labelled good; the unlabelled web text is every document that may teach, whatever
its label.  With the class prior ``p`` and the logistic loss ``l``, what negatives would cost is estimated without any:

    risk = p E+[l(g)] + max(0, E[l(-g)] - p E+[l(-g)])        (+ a ridge term)

The second part cannot be negative for a true sample; where its unclamped minimum falls below zero the classifier has
begun to learn the positives by heart.  The clamped risk is convex in pieces with a kink, and its minimum on the kink is
the minimum of p E+[l(g)] + t (E[l(-g)] - p E+[l(-g)]) for the ``t`` in [0, 1] at which the second part is zero: ``t`` is
found by bisection, each time by Newton steps.  Every step is one pass over all documents that teach; sums per
coordinate are added up in Spark, so the driver receives one gradient and one Hessian, whatever the number of tasks.
The prior is estimated from the labels that may be used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.arrow import chunks, lists, texts
from quantframe.session import staged

#: Marks whose share is a feature each.
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
#: Standardised features end at this many deviations.
FAR = 3.0
RIDGE = 0.03
#: The second part of the risk counts as zero within this.
NEAR_ZERO = 2e-3
KEPT_FROM = 0.7


def measures(text: str) -> list[float]:
    """Shares and counts of a whole text; an empty text has the measures of no words."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size, words = max(int(raw.sum()), 1), text.split()
    n, kinds = max(len(words), 1), Counter(words)
    lines = [line for line in text.split("\n") if line]
    return [
        np.log1p(len(words)), np.log1p(raw.sum()), np.log1p(size / n), np.log1p(len(lines)),
        raw[97:123].sum() / size, raw[65:91].sum() / size, raw[48:58].sum() / size, raw[128:].sum() / size, raw[32] / size,
        len(kinds) / n, max(kinds.values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n, len(set(lines)) / max(len(lines), 1),
        *np.log1p(1000 * raw[[ord(m) for m in MARKS]] / size),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 2 << 20):
        found = [np.array(measures(t), np.float32) for t in texts(batch)]
        yield pa.record_batch({"doc_id": batch.column(0), "x": lists(found, pa.float32())})


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _rows(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)


def _sum_up(rows: DataFrame, part) -> np.ndarray:
    """Sum over all rows of the vectors that ``part(x, trusted)`` gives for a batch; added up by coordinate in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for some in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                found = part(_rows(some.column(0)), some.column(1).to_numpy(zero_copy_only=False).astype(bool))
                total = found if total is None else total + found
        if total is not None:
            yield pa.record_batch({"sums": lists([total], pa.float64())})

    sums = rows.select("x", "trusted").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    found = sums.groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row a coordinate
    out = np.zeros(len(found))
    for i, v in found:
        out[i] = v
    return out


class Scale:
    """Mean and deviation of each measure over the documents that teach."""

    def __init__(self, rows: DataFrame):
        moments = lambda x, trusted: np.concatenate([[len(x), trusted.sum()], x.sum(0), (x * x).sum(0)])
        sums = _sum_up(rows, moments)
        self.n, self.trusted = sums[0], sums[1]
        mean, square = np.split(sums[2:] / self.n, 2)
        self.mean, self.spread = mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-9

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Standardised rows, with a constant in front."""
        z = np.clip((x - self.mean) / self.spread, -FAR, FAR)
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def fit(rows: DataFrame, scale: Scale, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the non-negative risk over ``rows(x, trusted)``."""
    size = len(scale.mean) + 1
    shrink = np.full(size, ridge)
    shrink[0] = 1e-6

    def passed(w: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient, Hessian and the negatives' part of the risk, in one pass."""

        def part(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
            z = scale(x)
            g = z @ w
            s, cost = _sigmoid(g), np.logaddexp(0, g)
            one, good = 1 / scale.n, prior / scale.trusted * trusted
            pull = t * one * s - good * (1 - s + t * s)
            bend = (t * one + (1 - t) * good) * s * (1 - s)
            return np.concatenate([[(one * cost - good * cost).sum()], pull @ z, ((z * bend[:, None]).T @ z).ravel()])

        sums = _sum_up(rows, part)
        return sums[1 : size + 1] + shrink * w, sums[size + 1 :].reshape(size, size) + np.diag(shrink), float(sums[0])

    def solve(w: np.ndarray, t: float, steps: int) -> tuple[np.ndarray, float]:
        for _ in range(steps):
            pull, bend, negative = passed(w, t)
            move = np.linalg.solve(bend, pull)
            length = np.linalg.norm(move)
            if length < 0.01:  # the risk's part belongs to weights this close
                break
            w = w - move * min(1.0, 4 / length)
        return w, negative

    w, negative = solve(np.zeros(size), 1.0, 20)
    low, high = 0.0, 1.0
    while negative < -NEAR_ZERO or (high < 1 and negative > NEAR_ZERO):
        if high - low < 1e-3:
            return solve(w, low, 20)[0]
        t = (low + high) / 2
        w, negative = solve(w, t, 12)
        low, high = (low, t) if negative < 0 else (t, high)
    return w


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` teach only where crc32 of the doc_id as text, modulo 4, is not 2: those of at least 1 give
    the trusted positives, all of them the prior (the share of positives).  A doc_id with several labels counts
    as good only if all say so; null labels are unknown.  The documents that are not held out are the unlabelled text.
    ``score`` is the chance of label 1, ``predicted`` is 1 from 0.7 on.  A null or empty text has the measures of no words.
    Without labels of both classes every score is the share of good labels (0 without any).  Rows that repeat a doc_id
    are scored each; other columns do not enter; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = labels.where("quality is not null and doc_id is not null").where(~is_held_out())
    usable = staged(usable.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("good")))
    prior = usable.agg(F.avg("good")).first()[0]
    result = (is_held_out().alias("held_out"), "score", (F.col("score") >= KEPT_FROM).cast("int").alias("predicted"))
    measured = docs.mapInArrow(_measured, "doc_id long, x array<float>")
    known = measured.join(usable, measured["doc_id"] == usable["label_id"], "left")
    known = staged(known.select("doc_id", "x", F.coalesce(F.col("good") == 1, F.lit(False)).alias("trusted"), is_held_out().alias("held_out")))
    teach = known.where("not held_out")
    if prior is None or prior in (0.0, 1.0) or teach.where("trusted").isEmpty():
        return known.withColumn("score", F.lit(float(prior or 0.0))).select("doc_id", *result)
    scale = Scale(teach)
    weights = fit(teach, scale, prior)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(_sigmoid(scale(_rows(batch.column(1))) @ weights))})

    return known.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double").select("doc_id", *result)

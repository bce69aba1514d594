"""Toxicity by weak supervision: mined lexicon and pattern voters, a generative label model, a linear classifier.

1.  Voters.  On a bounded sample of labelled rows, words (lexicon) and word beginnings of 4 to 7 letters
    (patterns; also found in two or in three different words of a text) that lean clearly to the toxic class
    are mined.  Those that share their first letters form one voter of their kind; a voter fires on a text
    that has any of them and abstains elsewhere.
2.  Label model.  A two-class generative model (each voter has a firing rate per class, the class is hidden
    where no label may be used) is fitted by expectation maximisation over all documents.  Voters that fire
    together more than the class explains share their weight.  An abstention says nothing; what a text is
    on which all abstain is read from the labels that may be used.
3.  Classifier.  A logistic regression on the mined features is fitted to the posterior labels of all
    documents that are not held out; every document is scored by it.  Known labels anchor the label model
    only: the classifier sees the posterior of labelled rows too, never the label itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.arrow import chunks, lists, texts
from quantframe.llm.near_text import shingles
from quantframe.session import staged

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
#: The most voters of the label model.
VOTERS = 192
#: A feature is mined from this log-likelihood ratio on, so that chance finds among millions of words are few.
SIGNAL = 25.0
#: Correlation from which two voters share their weight.
CLEAR = 0.3
#: Words kept in a task's memory with their features.
REMEMBERED = 150_000


def word_features(token: str) -> list[str]:
    """Lexicon (``w``) and pattern (``p``) features of the words in a lower-case token."""
    out = []
    for word in LETTERS.findall(token):
        if len(word) > 2:
            out.append("w" + word[:40])
            out.extend("p" + word[:k] for k in BEGINNINGS if len(word) >= k)
    return out


def text_features(text: str) -> set[str]:
    """All features of a text; ``q`` and ``r``: a pattern in at least two or three different tokens."""
    seen = Counter(f for token in set(text.lower().split()) for f in set(word_features(token)))
    more = [("r" if n > 2 else "q") + f[1:] for f, n in seen.items() if n > 1 and f[0] == "p"]
    return {*seen, *more, *("q" + f[1:] for f in more if f[0] == "r")}


def voters_of(names: list[str]) -> np.ndarray:
    """The voter of each feature: one for each kind and first four letters, shared in turn beyond VOTERS."""
    stems = {stem: i % VOTERS for i, stem in enumerate(sorted({f[:5] for f in names}))}
    return np.array([stems[f[:5]] for f in names])


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _tally(wanted: frozenset[str] | None):
    """Documents with each feature (of those wanted), summed for every megabyte of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            counts: Counter[str] = Counter()
            for text in texts(batch):
                counts.update(text_features(text) if wanted is None else text_features(text) & wanted)
            yield pa.record_batch({"feature": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def _least_shingle(column: pd.Series) -> pd.Series:
    """Smallest hash of the five-word shingles: the same for copies, and for most near copies."""
    return column.map(lambda t: int(s[0].view(np.int64)) if len(s := shingles(t or "", 5)) else 0)


def mine(docs: DataFrame, labelled: DataFrame, fit_rows: int, features: int) -> list[str]:
    """The features that lean most clearly to the toxic class, at most ``features`` of them.

    ``labelled(doc_id, toxic)``; the sample is the ``fit_rows`` rows with the smallest hash of doc_id.
    """
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts_of = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")  # at most fit_rows short rows
    # one text of each group of copies, near ones too: the words of a copied document would all look like its label
    texts_of = staged(texts_of.withColumn("group", F.pandas_udf(_least_shingle, "long")("text")))
    sample = texts_of.groupBy("group").agg(F.min("doc_id").alias("doc_id"), F.min_by("toxic", "doc_id").alias("toxic"))
    sample = staged(sample.select("doc_id", "toxic"))
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not toxic or not clean:
        return []
    read = texts_of.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


    def tally(label: int, wanted: frozenset[str] | None) -> DataFrame:
        part = read.where(F.col("toxic") == label).select("text").mapInArrow(_tally(wanted), "feature string, n long")
        return part.groupBy("feature").agg(F.sum("n").alias("toxic" if label else "clean"))

    found = staged(tally(1, None).where("toxic >= 3"))
    wanted = frozenset(r[0] for r in found.select("feature").collect())  # of at most fit_rows texts
    tallied = found.join(tally(0, wanted), "feature", "left").fillna(0, ["clean"])
    # log-likelihood ratio of the feature's split over the classes against the split of the sample
    seen, share = F.col("clean") + F.col("toxic"), toxic / (toxic + clean)
    term = lambda part, rate: F.when(part > 0, part * F.log(part / (seen * rate))).otherwise(0.0)
    signal = 2 * (term(F.col("toxic"), share) + term(F.col("clean"), 1 - share))
    lean = F.log((F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1)))
    best = tallied.select("feature", signal.alias("signal"), lean.alias("lean"))
    best = best.where((F.col("lean") > 3) & (F.col("signal") >= SIGNAL))
    return sorted(r[0] for r in best.orderBy(F.desc("signal"), "feature").limit(features).collect())


def _hits(names: list[str]):
    """Indices of the mined features in every whole text."""
    known = {f: i for i, f in enumerate(names)}
    stems = {f if f[0] == "w" else "p" + f[1:] for f in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in chunks(batches, "text", 2 << 20):
            found = []
            for text in texts(batch):
                mine: list[str] = []
                for token in set(text.lower().split()):
                    part = cache.get(token)
                    if part is None:
                        if len(cache) >= REMEMBERED:
                            cache.clear()
                        part = cache[token] = tuple(f for f in set(word_features(token)) if f in stems)
                    if part:
                        mine.extend(part)
                seen = Counter(mine)
                more = [k + f[1:] for f, n in seen.items() if n > 1 and f[0] == "p" for k in "qr"[: n - 1]]
                found.append(np.array(sorted(known[f] for f in (*seen, *more) if f in known), np.int32))
            yield pa.record_batch({"doc_id": batch.column(0), "hits": lists(found, pa.int32())})

    return run


class LabelModel:
    """Firing rates per class, the chance of the toxic class at large and where nothing fires, and
    the correlations that voters keep once the class is known."""

    def __init__(self, voters: int, share: float, silent: float):
        self.rate = np.full((2, voters), 0.5)
        self.share, self.silent, self.shared = share, silent, np.zeros((voters, voters))

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Chance of the toxic class for rows of 0/1 votes."""
        odds = np.where(fired.any(1), self.share / (1 - self.share), self.silent / (1 - self.silent))
        # voters that repeat each other on a text share one vote
        votes = fired / (1 + fired @ self.shared)
        logit = np.log(odds) + votes @ np.log(self.rate[1] / self.rate[0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def update(self, count: np.ndarray, fired: np.ndarray) -> None:
        self.rate = (fired + 0.5) / (count[:, None] + 1.0)

    def correlate(self, count: np.ndarray, fired: np.ndarray, both: np.ndarray) -> None:
        """The clear correlations that the class leaves unexplained."""
        worst = np.zeros_like(both[0])
        for c in (0, 1):
            mean = fired[c] / max(count[c], 1)
            cov = both[c] / max(count[c], 1) - np.outer(mean, mean)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            enough = np.minimum.outer(fired[c], fired[c]) >= 5
            worst = np.maximum(worst, np.where(enough, cov / np.outer(spread, spread), 0))
        np.fill_diagonal(worst, 0)
        self.shared = np.where(worst >= CLEAR, np.minimum(worst, 1), 0)


def _votes(hits: pa.Array, voter: np.ndarray, voters: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(hits)), hits.value_lengths().fill_null(0).to_numpy())
    out = np.zeros((len(hits), voters))
    out[rows, voter[hits.flatten().to_numpy()]] = 1
    return out


def _expect(model: LabelModel | None, voter: np.ndarray, voters: int, pairs: bool):
    """Sums that the next step of the label model needs: one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, silent, fired, both = np.zeros(2), np.zeros(2), np.zeros((2, voters)), np.zeros((2, voters, voters))
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                votes = _votes(part.column(0), voter, voters)
                n = part.column(2).to_numpy().astype(float)
                label = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(label)
                toxic = np.where(known, label, model.posterior(votes) if model else 0.0)
                n = n if model else n * known
                for c, p in enumerate((n * (1 - toxic), n * toxic)):
                    count[c] += p.sum()
                    silent[c] += p[votes.sum(1) == 0].sum()
                    fired[c] += p @ votes
                    if pairs:
                        both[c] += votes.T @ (votes * p[:, None])
        yield pa.record_batch({"sums": lists([np.concatenate([count, silent, fired.ravel(), both.ravel() if pairs else []])], pa.float64())})

    return run


def fit_label_model(patterns: DataFrame, names: list[str], rounds: int = 5) -> LabelModel:
    """Expectation maximisation over ``patterns(hits, label, n)``; known labels stay as they are."""
    voters, voter = VOTERS, voters_of(names)

    def sums(model: LabelModel | None, pairs: bool = False):
        parts = patterns.mapInArrow(_expect(model, voter, voters, pairs), "sums array<double>").collect()  # a row a task
        total = np.sum([np.array(r[0]) for r in parts], axis=0)
        return total[:2], total[2:4], *np.split(total[4:].reshape(-1, voters), [2])

    count, silent, fired, _ = sums(None)  # labelled rows only
    model = LabelModel(voters, float((count[1] + 0.5) / (count.sum() + 1)), float((silent[1] + 0.5) / (silent.sum() + 1)))
    model.update(count, fired)
    for _ in range(rounds):
        count, _, fired, both = sums(model, pairs=True)
        model.update(count, fired)
        model.correlate(count, fired, both.reshape(2, voters, voters))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, features: int = 2048) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` teaches only through rows that are not held out (crc32 of the doc_id as text,
    modulo 5, is not 0); a doc_id with several labels counts as toxic if one says so, null labels are unknown.
    Voters are mined on at most ``fit_rows`` labelled rows; the label model and the classifier use all.
    A null or empty text has no features and gets the score of such texts.  Without labels of both classes
    every score is the share of toxic labels (0 without any).  Rows that repeat a doc_id are scored each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = labels.where("toxic is not null and doc_id is not null").where(~is_held_out())
    labelled = labelled.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    labelled = staged(labelled)
    names = mine(docs, labelled, fit_rows, features)
    result = (is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    if not names:
        share = labelled.agg(F.avg("toxic")).first()[0] or 0.0
        return docs.withColumn("score", F.lit(float(share))).select("doc_id", *result)

    read = staged(docs.mapInArrow(_hits(names), "doc_id long, hits array<int>"))
    known = read.join(labelled.withColumnRenamed("toxic", "label"), "doc_id", "left").withColumn("held_out", is_held_out())
    patterns = staged(known.groupBy("hits", F.col("label").cast("double").alias("label"), "held_out").agg(F.count(F.lit(1)).alias("n")))
    model = fit_label_model(patterns.select("hits", "label", "n"), names)

    voter = voters_of(names)

    @F.pandas_udf("double")
    def posterior(hits: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(_votes(pa.array(hits.to_list(), pa.list_(pa.int32())), voter, VOTERS)))

    size = len(names)
    sparse = F.udf(lambda hits: SparseVector(size, [int(i) for i in hits], [1.0] * len(hits)), VectorUDT())
    teach = patterns.where("not held_out").withColumn("p", posterior("hits"))
    teach = teach.groupBy("hits").agg(F.sum(F.expr("n * p")).alias("toxic"), F.sum(F.expr("n * (1 - p)")).alias("clean"))
    teach = teach.select(sparse("hits").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("toxic").alias("w")), F.struct(F.lit(0.0).alias("label"), F.col("clean").alias("w")))).alias("x"))
    teach = staged(teach.select("features", "x.label", "x.w").where("w > 1e-6"))
    line = LogisticRegression(weightCol="w", regParam=1e-5, maxIter=100, standardization=False).fit(teach)
    slope, offset = line.coefficients.toArray(), float(line.intercept)

    @F.pandas_udf("double")
    def score(hits: pd.Series) -> pd.Series:
        sums = np.array([slope[h].sum() if len(h) else 0.0 for h in hits]) + offset
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    return read.withColumn("score", score("hits")).select("doc_id", *result)

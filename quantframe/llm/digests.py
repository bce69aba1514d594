"""Document fingerprints from improbable byte windows.

The Shannon entropy of every 32-byte window is put into one of ENTROPIES classes.  How often a class occurs
in the whole corpus says how improbable a window is; a window that is the most improbable of its
neighbourhood many times over becomes a feature.  Features go into a chain of Bloom filters, a new one
after FULL features, and two fingerprints are compared by the share of common bits beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.arrow import chunks, lists, texts
from quantframe.session import staged

WINDOW, ENTROPIES = 32, 1024
#: A feature is the rarest window in at least so many of the WINDOW neighbourhoods that hold it.
POPULAR = 8
#: Bits of a filter, probes of a feature, and features until the next filter begins.
BITS, PROBES, FULL = 2048, 5, 160
#: Bytes handled at a time.
BLOCK = 1 << 18
_COUNTS = np.arange(WINDOW + 2, dtype=np.float64)
_TERMS = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * 1024).astype(np.int32)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class of every whole window's entropy, by what one byte leaving and one entering change."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = data[d:] == data[:-d]
        before[d:] += same
        after[:-d] += same
    # sum of c*log(c) over a window: enter with `before` equal bytes in it, leave with `after` ones behind
    grow = _TERMS[before + 1] - _TERMS[before]
    total = int(sum(_TERMS[c] for c in np.bincount(data[:WINDOW], minlength=256)))
    drop = _TERMS[after + 1] - _TERMS[after]
    steps = grow[WINDOW:].astype(np.int64) - drop[: n - WINDOW]
    sums = total + np.concatenate([[0], np.cumsum(steps)])
    entropy = np.log2(WINDOW) - sums / (1024.0 * WINDOW)
    return np.clip(entropy * (ENTROPIES / np.log2(WINDOW)), 0, ENTROPIES - 1).astype(np.int64)


def _blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Long texts in blocks that overlap so that every window lies whole in exactly one."""
    for start in range(0, max(len(data) - WINDOW + 1, 0), BLOCK):
        yield data[start : start + BLOCK + WINDOW - 1]


def all_classes(data: list[bytes]) -> list[np.ndarray]:
    """Entropy classes of many texts, computed end to end; windows across two texts are left out."""
    joined = np.frombuffer(b"".join(data), np.uint8)
    classes = np.concatenate([np.empty(0, np.int64), *(entropy_classes(b) for b in _blocks(joined))])
    ends = np.cumsum([len(d) for d in data])
    return [classes[e - len(d) : max(e - WINDOW + 1, e - len(d))] for d, e in zip(data, ends)]


def feature_starts(classes: np.ndarray, commonness: np.ndarray) -> np.ndarray:
    """Windows that are popular: rarest (leftmost among equals) in POPULAR neighbourhoods or more."""
    n = len(classes)
    if n == 0:
        return np.empty(0, np.int64)
    rank = commonness[classes].astype(np.int64) * (n + 1) + np.arange(n)
    low, width = rank, 1
    while width < WINDOW and len(low) > width:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    votes = np.bincount(low % (n + 1), minlength=n)
    return np.flatnonzero(votes >= min(POPULAR, max(votes.max(), 1)))


def _hashed(windows: np.ndarray) -> np.ndarray:
    """PROBES filter positions for rows of WINDOW bytes."""
    words = np.ascontiguousarray(windows).view(np.uint64)
    out = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0x165667B19E3779F9)
    out ^= out >> np.uint64(29)
    return np.stack([(out >> np.uint64(11 * k)) % np.uint64(BITS) for k in range(PROBES)], axis=1).astype(np.int64)


def fingerprint(text: bytes, classes: np.ndarray, commonness: np.ndarray) -> np.ndarray:
    """Chained filters of a text, one row of bits each; none for an empty text.

    A text shorter than a window is one feature, filled up with zero bytes.
    """
    if not text:
        return np.empty((0, BITS), bool)
    if len(text) < WINDOW:
        probes = _hashed(np.frombuffer(text.ljust(WINDOW, b"\0"), np.uint8)[None, :])
    else:
        data = np.frombuffer(text, np.uint8)
        starts = feature_starts(classes, commonness)
        probes = _hashed(data[starts[:, None] + np.arange(WINDOW)])
    filters = np.zeros((-(-len(probes) // FULL), BITS), bool)
    filters[np.repeat(np.arange(len(probes)) // FULL, PROBES), probes.ravel()] = True
    return filters


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """0 to 1: mean, weighted by bits, over the filters of the shorter chain, of the best overlap with the other's filters.

    The overlap counts from what filters of that many bits share by chance up to all bits of the emptier one.
    """
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    left, right = (left, right) if len(left) <= len(right) else (right, left)
    n_left, n_right = left.sum(1).astype(float), right.sum(1).astype(float)
    common = left.astype(np.float32) @ right.astype(np.float32).T
    least = np.minimum.outer(n_left, n_right)
    chance = np.outer(n_left, n_right) / BITS
    chance += 2 * np.sqrt(np.maximum(chance, 0))
    share = np.where(least > chance, (common - chance) / np.maximum(least - chance, 1e-9), common >= least)
    return float(np.average(np.clip(share, 0, 1).max(1), weights=n_left))


def encoded(filters: np.ndarray) -> str:
    return base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ENTROPIES, np.int64)
    for batch in chunks(batches, "text", 4 << 20):
        for part in all_classes([t.as_py() for t in batch.column(0)]):
            total += np.bincount(part, minlength=ENTROPIES)
    yield pa.record_batch({"counts": lists([total], pa.int64())})


def corpus_commonness(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy class by how many windows of the whole corpus have it, rarest first.

    A task returns one row of ENTROPIES counts; those are added up by class before they reach the driver.
    """
    parts = docs.where("text is not null").select(F.col("text").cast("binary").alias("text")).mapInArrow(_census, "counts array<long>")
    summed = parts.select(F.posexplode("counts").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ENTROPIES, np.int64)
    for row in summed:
        counts[row[0]] = row[1]
    order = np.argsort(counts, kind="stable")
    ranks = np.empty(ENTROPIES, np.int64)
    ranks[order] = np.arange(ENTROPIES)
    return ranks


def _compared(commonness: np.ndarray):
    """Rows of one range in descending order; those that are only borrowed close the range."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def made(data: list[bytes]) -> list[np.ndarray]:
        return [fingerprint(d, c, commonness) for d, c in zip(data, all_classes(data))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in chunks(batches, "text", 2 << 20):
            data = texts(batch)
            own = made([t.encode("utf-8", "surrogatepass") for t in data])
            rows = [*last, *zip(batch.column(0).to_pylist(), data, own, batch.column(2).to_pylist())]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3]]
            edited = [(a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3]).encode("utf-8", "surrogatepass") for a, b in pairs]
            out = [
                (a[0], len(a[1]), hashlib.sha256(e).hexdigest(), encoded(a[2]), encoded(f), likeness(a[2], f), likeness(a[2], b[2]))
                for (a, b), e, f in zip(pairs, edited, made(edited))
            ]
            last = rows[-1:]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=list(names))

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text of ``docs(doc_id, text)``, of its edited text, and how alike they are.

    The edited text takes its last third (floor of a third of the code points) from the beginning of the
    next document by descending doc_id; after the last one comes the first.  Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  A null text is empty: no
    features, like another empty text only.  Rows that repeat a doc_id follow each other by text; null
    doc_ids come last.  Other columns are ignored.

    Documents are dealt to id ranges at quantiles of doc_id, as many as the session has shuffle partitions;
    the first document of the following range is lent to each range, so texts move once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    commonness = corpus_commonness(docs)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = staged(docs.select("doc_id", F.xxhash64("text").alias("hash")))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 50 * ranges)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # range 0 holds the largest ids; null ids go to the last range
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(bounds, lambda c: c >= F.col("doc_id")))).cast("int")
    first = ids.withColumn("range", place).groupBy("range").agg(F.max(F.struct("doc_id", "hash")).alias("top"))
    first = sorted((r[0], r[1][0], r[1][1]) for r in first.collect())  # a row per range
    lend = [(first[k][0], *first[(k + 1) % len(first)][1:]) for k in range(len(first))]
    lend = spark.createDataFrame(lend, "to_range int, lent_id long, lent_hash long")
    own = docs.withColumns({"borrowed": F.lit(False), "range": place})
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    lent = hashed.join(F.broadcast(lend), hashed["doc_id"].eqNullSafe(lend["lent_id"]) & (hashed["hash"] == lend["lent_hash"]))
    lent = lent.groupBy("to_range", "doc_id", "hash").agg(F.first("text").alias("text"))
    lent = lent.select("doc_id", "text", F.lit(True).alias("borrowed"), F.col("to_range").alias("range"))
    dealt = own.unionByName(lent).repartitionById(len(cuts) + 1, F.col("range"))
    ordered = dealt.sortWithinPartitions("borrowed", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).select("doc_id", "text", "borrowed")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compared(commonness), schema)

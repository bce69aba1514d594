"""Packing of documents into fixed-length sequences along a Hilbert curve.

Every document's ids are hashed into a few dimensions (a signed random projection of its token
counts), the point's index on a Hilbert curve becomes the sort key, and documents that follow each
other along the curve are laid end to end and cut into sequences, so a sequence holds similar texts
and no padding arises between documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.arrow import chunks, texts
from quantframe.llm.tokens import encode
from quantframe.session import staged

#: Dimensions and bits of a coordinate: 5 * 8 = 40 bits of curve index.
DIMS, BITS = 5, 8
ID_SPACE = 1 << 17


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (one row each), by Gray-code reflections per bit plane."""
    x = coords.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(n):
            set_ = (x[:, d] & bit) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(set_, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[:, -1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << 1) | ((x[:, d] >> level) & 1)
    return out


def _signs() -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (ID_SPACE, DIMS))


def _tokenized(json_path: str, rank_path: str, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _signs()
        for batch in chunks(batches, "text", 2 << 20):
            blobs, sizes, points = [], [], []
            for text in texts(batch):
                ids = np.append(encode(text, json_path, rank_path, pattern), np.uint32(end_id))
                blobs.append(ids.astype("<u4").tobytes())
                sizes.append(len(ids))
                body = ids[:-1] % ID_SPACE
                points.append(signs[body].sum(0) / np.sqrt(max(len(body), 1)) if len(body) else np.zeros(DIMS))
            # each coordinate is near normal after the scaling; a logistic curve spreads it over the cells
            cells = np.minimum((1 << BITS) / (1 + np.exp(-0.5 * np.stack(points))), (1 << BITS) - 1).astype(np.int64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "key": pa.array(hilbert_index(cells, BITS)),
                    "doc_tokens": pa.array(sizes, pa.int64()),
                    "ids": pa.array(blobs, pa.binary()),
                }
            )

    return run


def tail_cuts(total: int, length: int) -> list[int]:
    """Ends of the sequences after the last full one: one for each power of two in what is left."""
    at, out = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def _pieces(length: int, total: int):
    """Cut the stream of a partition; its first row tells where in the corpus the partition starts."""
    full, tails = total - total % length, tail_cuts(total, length)

    def room(at: int) -> tuple[int, int, int]:
        """Sequence, offset in it and its end for a position of the corpus."""
        if at < full:
            return at // length, at % length, at - at % length + length
        k = next(i for i, end in enumerate(tails) if at < end)
        start = tails[k - 1] if k else full
        return full // length + k, at - start, tails[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece")}
            for doc, size, blob, base in zip(*(batch.column(i) for i in range(4))):
                at = base.as_py() if at is None else at
                data, size, start = blob.as_buffer(), size.as_py(), 0
                while start < size:
                    sequence, offset, end = room(at)
                    take = min(size - start, end - at)
                    piece = data.slice(4 * start, 4 * take)
                    for name, value in zip(rows, (doc.as_py(), start, take, zlib.crc32(piece), size, sequence, offset, piece.to_pybytes())):
                        rows[name].append(value)
                    start, at = start + take, at + take
            kinds = {"piece": pa.binary()}
            yield pa.record_batch({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()})

    return run


def pack(docs: DataFrame, json_path: str, rank_path: str, pattern: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of ``length`` ids (a power of two) along the curve.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and
    ``piece`` (the ids, little-endian 32 bits).  All sequences are full but the last few, whose lengths
    are powers of two, so there is no padding at all.  A null or empty text is the end id alone; rows
    that repeat a doc_id are packed each for itself; a null doc_id stays null; other columns are ignored.

    The corpus is cut into as many curve ranges as the session has shuffle partitions, at quantiles of
    (curve index, row hash), so a third of all documents on one point of the curve still spread out.
    Only one row per range (its id count) is gathered.
    """
    spark = docs.sparkSession
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = source.mapInArrow(_tokenized(json_path, rank_path, pattern, end_id), "doc_id long, key long, doc_tokens long, ids binary")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 22))
    coded = staged(coded.withColumn("place", F.col("key") * F.lit(1 << 22) + salt))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = coded.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)] or [0.5], 50 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    # the ordinal of the range: how many cuts lie below the place; an expression, so the ids do not wait in a queue for Python
    below = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda cut: cut < F.col("place")))
    placed = coded.withColumn("range", below)
    counted = placed.groupBy("range").agg(F.sum("doc_tokens").alias("n"))
    counted = sorted((r[0], r[1]) for r in counted.collect())  # one row per range
    base, total = {}, 0
    for number, n in counted:
        base[number], total = total, total + n
    starts = spark.createDataFrame(list(base.items()) or [(0, 0)], "range int, base long")
    dealt = placed.join(F.broadcast(starts), "range").repartitionById(len(cuts) + 1, F.col("range"))
    ordered = dealt.sortWithinPartitions("place", "doc_id", "doc_tokens", F.crc32("ids"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, piece binary"
    return ordered.select("doc_id", "doc_tokens", "ids", "base").mapInArrow(_pieces(length, total), schema)

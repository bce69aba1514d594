"""Token sequences in training order: a keyed permutation gives every sequence its slot in fixed-stride shards.

The ids of a partition's documents are laid end to end and cut into sequences.  A Feistel network over the
smallest even number of bits that holds all sequence numbers, walked along its cycle until it falls inside,
permutes 0..n-1 without a table.  Slots are dealt to range partitions whose bounds are shard bounds, so every
shard is written by one task, in order, and a reader finds slot s at byte (s mod shard) * stride.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.llm.arrow import chunks, texts
from quantframe.llm.tokens import encode
from quantframe.session import shared_dir, staged

ROUNDS = 6
#: Sequences that are compressed together: the kept ids then take about half as much disk as the shards.
TOGETHER = 512


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """Slots of ``numbers`` in 0..size-1 under the keyed permutation of that range."""
    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key + turn * 0x51ED270B) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(size)]  # outside: walk on along the cycle
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], code, length: int, end_id: int):
    """``(first doc, last doc, ids)`` of a partition's sequences; the last one may be short."""
    waiting, size, owners = [], 0, []
    for batch in chunks(batches, "text", 2 << 20):
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
            ids = np.append(code(text), np.uint32(end_id))
            while len(ids):
                take = ids[: length - size]
                waiting.append(take)
                owners.append(doc)
                size, ids = size + len(take), ids[len(take) :]
                if size == length:
                    yield owners[0], owners[-1], np.concatenate(waiting)
                    waiting, size, owners = [], 0, []
    if size:
        yield owners[0], owners[-1], np.concatenate(waiting)


def _coded(paths: tuple[str, str, str], length: int, end_id: int):
    """Sequences of a partition, up to ``TOGETHER`` of them as one compressed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codec = TaskContext.get().partitionId(), pa.Codec("zstd", compression_level=9)
        rows: list[tuple] = []
        done = 0

        def flush() -> pa.RecordBatch:
            first, last, ids = zip(*rows)
            if any(int(i.max()) > 0xFFFF for i in ids):
                raise ValueError("an id does not fit 16 bits: shards hold vocabularies of at most 65,536 ids")
            blob = np.concatenate(ids).astype("<u2").tobytes()
            docs = [pa.array([x], pa.list_(pa.int64())) for x in (first, last, [len(i) for i in ids])]
            return pa.record_batch(
                [pa.array([part], pa.int64()), pa.array([done - len(rows)], pa.int64()), *docs, pa.array([codec.compress(blob, asbytes=True)], pa.binary())],
                names=["part", "at", "first", "last", "sizes", "ids"],
            )

        for row in _sequences(batches, lambda t: encode(t, *paths), length, end_id):
            rows.append(row)
            done += 1
            if len(rows) == TOGETHER:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return run


def _placed(key: int, starts: dict[int, int], size: int):
    """A row for each sequence with its slot; the ids travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for part, at, first, last, sizes, blob in zip(*(c.to_pylist() for c in batch.columns)):
                ends = 2 * np.cumsum(sizes)
                data = codec.decompress(blob, int(ends[-1]), asbytes=True)
                start = starts[part] + at
                yield pa.record_batch(
                    {
                        "slot": pa.array(permuted(np.arange(start, start + len(sizes)), size, key)),
                        "first_doc_id": pa.array(first, pa.int64()),
                        "last_doc_id": pa.array(last, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids": pa.array([codec.compress(data[e - 2 * n : e], asbytes=True) for n, e in zip(sizes, ends)], pa.binary()),
                    }
                )

    return run


def _written(path: str, length: int, per_shard: int, end_id: int, size: int):
    """Write a range's shards; a shard that is already whole is left as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        stride = 2 * length
        buffer, shard = bytearray(), None

        def close() -> None:
            if shard is None:
                return
            want = (min(size, (shard + 1) * per_shard) - shard * per_shard) * stride
            if len(buffer) != want:
                raise ValueError(f"shard {shard} has {len(buffer)} of {want} bytes")
            name = f"{root}/shard-{shard:08d}.bin"
            if store.get_file_info(name).size == want:
                return
            part = f"{root}/_{uuid.uuid4().hex}"  # whole under another name first, so no reader meets a part
            with store.open_output_stream(part) as out:
                out.write(buffer)
            store.move(part, name)

        codec = pa.Codec("zstd")
        for batch in batches:
            crcs, shards, offsets = [], [], []
            for slot, n, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if slot // per_shard != shard:
                    close()
                    buffer, shard = bytearray(), slot // per_shard
                data = codec.decompress(ids.as_buffer(), 2 * n, asbytes=True)
                offsets.append(len(buffer))
                shards.append(shard)
                crcs.append(zlib.crc32(data))
                buffer += data
                buffer += np.full((stride - len(data)) // 2, end_id, "<u2").tobytes()
            yield pa.record_batch(
                [*(batch.column(i) for i in range(4)), pa.array(shards, pa.int64()), pa.array(offsets, pa.int64()), pa.array(crcs, pa.int64())],
                names=["slot", "first_doc_id", "last_doc_id", "n_tokens", "shard", "byte_offset", "ids_crc32"],
            )
        close()

    return run


def _scanned(length: int, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard, data = int(path[-12:-4]), content.as_buffer()
                n = len(data) // (2 * length)
                rows = [data.slice(2 * length * i, 2 * length).to_pybytes() for i in range(n)]
                yield pa.record_batch({"slot": pa.array(range(shard * per_shard, shard * per_shard + n), pa.int64()), "stored": pa.array(rows, pa.binary())})

    return run


def read_shards(spark: SparkSession, path: str, length: int, per_shard: int) -> DataFrame:
    """``(slot, stored)`` of all shards: the bytes of each slot, padding included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    return files.select("path", "content").mapInArrow(_scanned(length, per_shard), "slot long, stored binary")


def materialise(
    docs: DataFrame, path: str, json_path: str, rank_path: str, pattern: str,
    length: int = 2048, end_id: int = 1, key: int = 20_240_229, per_shard: int = 512,
) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` as shards under ``path`` and return their index.

    One row per sequence: ``slot, shard, byte_offset, n_tokens, first_doc_id, last_doc_id, ids_crc32``.  Ids
    are little-endian unsigned 16-bit (a larger id is an error); a short sequence (the last of an input partition) is padded with the
    end id.  A null or empty text is the end id alone; an empty table gives no shards; repeated rows are
    written each; other columns are ignored.  Texts are encoded once: the compressed sequences are kept in the shared
    folder, from where they are counted and written.  A task that is repeated writes the same bytes again.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = "part long, at long, first array<long>, last array<long>, sizes array<long>, ids binary"
    kept = staged(docs.mapInArrow(_coded((json_path, rank_path, pattern), length, end_id), coded))
    counts = sorted((r[0], r[1]) for r in kept.groupBy("part").agg(F.sum(F.size("sizes"))).collect())  # a row a partition
    starts, size = {}, 0
    for part, n in counts:
        starts[part], size = size, size + n
    shards = -(-size // per_shard)
    ranges = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "slot long, first_doc_id long, last_doc_id long, n_tokens long, ids binary"
    placed = kept.mapInArrow(_placed(key, starts, size), schema)
    home = F.floor(F.floor(F.col("slot") / per_shard) * ranges / max(shards, 1)).cast("int")
    dealt = placed.repartitionById(ranges, home).sortWithinPartitions("slot")
    index = "slot long, first_doc_id long, last_doc_id long, n_tokens long, shard long, byte_offset long, ids_crc32 long"
    return staged(dealt.mapInArrow(_written(path, length, per_shard, end_id, size), index))


def write_and_read(docs: DataFrame, json_path: str, rank_path: str, pattern: str, length: int = 2048, per_shard: int = 512) -> DataFrame:
    """Materialise into the shared folder, read every shard back and add ``stored_crc32`` of each slot's ids."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}/shards-{uuid.uuid4().hex}"
    path = path if ":" in path else f"file://{path}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    index = materialise(docs, path, json_path, rank_path, pattern, length, per_shard=per_shard)
    stored = read_shards(spark, path, length, per_shard).withColumnRenamed("slot", "s")
    joined = index.join(stored.select("s", F.crc32("stored").alias("slot_crc32")), F.col("slot") == F.col("s")).drop("s")
    return joined

"""Merkle manifest of a document table, built by aligned appends with incremental witnesses.

1.  Leaves are hashed in Spark and put in order: one range sort, positions from the row counts of the ranges.
2.  The leaves of a key are cut into blocks of ``BLOCK`` positions that start at multiples of it.  A task reads its
    blocks in order and appends leaf after leaf to a stack of open subtrees.  Every open subtree holds the partial
    witnesses (siblings so far) of its leaves; completing a sibling joins two subtrees of equal height and extends
    the witnesses on both sides.  Sealing a block raises what is left open, a run of one at a time.
3.  The roots of the blocks are appended in the same way as leaves of the next level until a key has one root, and
    the roots of the keys as leaves of one last tree.  Witnesses are then extended downwards by joins on
    (key, block), at most ``BLOCK`` rows a block, whatever the size of the key.

A task holds one block at a time; nothing but row counts reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.session import staged

BITS = 10
BLOCK = 1 << BITS
#: Rows of a range or of a task that appends.
TASK_ROWS = 1 << 15
STEP = T.StructType([T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())])


def leaf(*values: Column) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


class OpenTrees:
    """A stack of open subtrees, growing by aligned appends, with the partial witnesses of their leaves."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int, bytes]] = []  # height, first leaf, root; heights fall from left to right
        self.sibling = np.zeros((BLOCK, BITS, 32), np.uint8)
        self.side = np.zeros((BLOCK, BITS), np.int8)  # -1: the sibling stands on the left, 1: on the right, 0: none
        self.n = 0

    def append(self, node: bytes) -> None:
        height, first = 0, self.n
        self.n += 1
        while self.open and self.open[-1][0] == height:
            first, node = self._completed(first, node, height)
            height += 1
        self.open.append((height, first, node))

    def _completed(self, first: int, node: bytes, height: int) -> tuple[int, bytes]:
        """Join the last open subtree with its sibling, which ends at the last leaf, and extend both sides' witnesses."""
        _, start, left = self.open.pop()
        self.sibling[start:first, height] = np.frombuffer(node, np.uint8)
        self.side[start:first, height] = 1
        self.sibling[first : self.n, height] = np.frombuffer(left, np.uint8)
        self.side[first : self.n, height] = -1
        return start, hashlib.sha256((left.hex() + node.hex()).encode()).digest()

    def seal(self, height: int) -> bytes:
        """Root at ``height``: what is open is completed from the right, a run of one becomes its own hash."""
        at, first, node = self.open.pop()
        for level in range(at, height):
            if self.open and self.open[-1][0] == level:
                first, node = self._completed(first, node, level)
            else:
                node = hashlib.sha256(node.hex().encode()).digest()
        return node

    def witnesses(self, height: int) -> pa.Array:
        """``list<struct<left, right>>`` of every leaf; the side that has no sibling is empty."""
        side, sibling = self.side[: self.n, :height], self.sibling[: self.n, :height]

        def of(which: int) -> pa.Array:
            has = side.ravel() == which
            ends = np.concatenate([[0], np.cumsum(32 * has)]).astype(np.int32)
            data = sibling.reshape(-1, 32)[has].tobytes()
            return pa.Array.from_buffers(pa.binary(), self.n * height, [None, pa.py_buffer(ends), pa.py_buffer(data)])

        steps = pa.StructArray.from_arrays([of(-1), of(1)], ["left", "right"])
        return pa.ListArray.from_arrays(np.arange(self.n + 1, dtype=np.int32) * height, steps)

    def clear(self) -> None:
        self.open, self.n = [], 0
        self.side[:] = 0


def _append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, block and position; adds the block's root and the witness inside the block."""
    trees, held, block = OpenTrees(), [], None

    def sealed() -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        height = min(BITS, (rows.column("n")[0].as_py() - 1).bit_length())
        root = trees.seal(height)
        out = dict(zip(rows.schema.names, rows.columns, strict=True))
        out |= {"root": pa.array([root] * trees.n, pa.binary()), "witness": trees.witnesses(height)}
        trees.clear()
        held.clear()
        return pa.record_batch(out)

    for batch in batches:
        keys = list(zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), strict=True))
        nodes, start = batch.column("node").to_pylist(), 0
        for i, key in enumerate(keys):
            if key != block:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield sealed()
                block, start = key, i
            trees.append(nodes[i])
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield sealed()


def in_order(df: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, int, int]:
    """Rows with ``pos``, their rank inside ``key`` (a null is a key), and ``n``, the key's row count; all rows, the largest ``n``.

    One range sort over (key, order), so a hot key spreads over ranges; ranks come from counts per key and range.
    """
    total = df.count()
    parts = max(1, math.ceil(total / TASK_ROWS))
    ranged = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    ranged = staged(ranged.withColumn("at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    upto, whole = Window.partitionBy("k").orderBy("p"), Window.partitionBy("k")
    counts = ranged.groupBy(F.col(key).alias("k"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("low"))
    counts = counts.select("k", "p", "low", (F.sum("c").over(upto) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    on = (ranged["part"] == counts["p"]) & ranged[key].eqNullSafe(counts["k"])
    placed = ranged.join(counts, on).select(*df.columns, (F.col("at") - F.col("low") + F.col("before")).alias("pos"), "n")
    return placed, total, counts.agg(F.max("n")).first()[0] or 0


def _level(nodes: DataFrame, rows: int) -> DataFrame:
    """``nodes(key, pos, n, node, …)`` with ``block``, the block's ``root`` and the ``witness`` inside it."""
    tasks = max(1, math.ceil(rows / TASK_ROWS))
    blocks = nodes.withColumn("block", F.shiftright("pos", BITS)).repartition(tasks, "key", "block").sortWithinPartitions("key", "block", "pos")
    schema = T.StructType([*blocks.schema.fields, T.StructField("root", T.BinaryType()), T.StructField("witness", T.ArrayType(STEP))])
    return staged(blocks.mapInArrow(_append, schema))


def grow(nodes: DataFrame, rows: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Trees over ``rows`` ``nodes(key, pos, n, node, …)``: the nodes with their whole ``witness``, and ``(key, root)``.

    ``most`` is the largest ``n``, the number of nodes of a key.
    """
    levels = []
    while True:
        levels.append(_level(nodes, rows))
        if most <= BLOCK:
            break
        # the first row of a block carries its root: block roots are the next level's appends
        most = math.ceil(most / BLOCK)
        first = levels[-1].where(F.col("pos") % BLOCK == 0)
        nodes = first.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("root").alias("node"))
        rows = nodes.count()
    roots = levels[-1].where("pos = 0").select("key", "root")
    upper = levels.pop().drop("root", "block")
    while levels:
        low, up = levels.pop().drop("root"), upper.select(F.col("key").alias("k"), F.col("pos").alias("b"), F.col("witness").alias("more"))
        met = low.join(up, low["key"].eqNullSafe(up["k"]) & (low["block"] == up["b"]))
        upper = met.withColumn("witness", F.concat("witness", "more")).drop("k", "b", "more", "block")
    return upper, roots


def digest_text(column: Column) -> Column:
    return F.lower(F.hex(column))


def fold(start: Column, witness: Column) -> Column:
    """Root (hex text) that a leaf (hex text) and its witness give."""
    step = lambda node, s: F.sha2(F.concat(digest_text(s["left"]), node, digest_text(s["right"])), 256)
    return F.aggregate(witness, start, step)


def proof_digest(witness: Column) -> Column:
    """SHA-256 of the witness's digests (hex text), from the leaf to the root, left to right."""
    texts = F.transform(witness, lambda s: F.concat(digest_text(s["left"]), digest_text(s["right"])))
    return F.sha2(F.array_join(texts, ""), 256)


def manifest(leaves: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with a binary ``leaf``) and, per row, ``subroot``, ``root`` (binary) and ``witness``.

    The witness is an array of ``struct<left, right>`` from the leaf through the subroot to the root; the side without
    a sibling is empty.  Leaves of a ``key`` ascend by ``order`` (nulls first), equal ones by leaf; a null is a key.
    """
    given = leaves.select(F.col(key).alias("key"), F.struct(*leaves.columns).alias("row"), F.col("leaf").alias("node"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    # equal rows are told apart by a written number, so that no range must hold them all
    given = staged(given.withColumn("place", F.monotonically_increasing_id()))
    names = [f"o{i}" for i in range(len(order))]
    placed, rows, most = in_order(given, "key", [*names, "node", "place"])
    grown, subroots = grow(placed.drop(*names, "place"), rows, most)
    keys, rows, most = in_order(subroots.select(F.lit(0).alias("all"), "key", F.col("root").alias("node")), "all", ["key"])
    keys, roots = grow(keys.select(F.col("all").alias("key"), "pos", "n", "node", F.struct("key").alias("of")), rows, most)
    root = roots.select("root").scalar()
    top = keys.select(F.col("of.key").alias("k"), F.col("node").alias("subroot"), F.col("witness").alias("more"), root.alias("root"))
    met = grown.join(top, grown["key"].eqNullSafe(top["k"]))
    return met.select("row.*", "subroot", "root", F.concat("witness", "more").alias("witness"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs(doc_id, source, lang, n_chars, text)`` with a tampering test of some rows.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` and the ``witness`` itself.  Where 7
    divides crc32 of the decimal doc_id, ``folded_root`` starts from the leaf with n_chars + 1 (a null n_chars stays), else
    from the leaf itself; it always uses the original witness.  A null lang is a language of its own, before the others;
    null doc_ids come first in theirs and are never tampered with; rows that repeat a doc_id ascend by leaf.  Null and
    empty columns hash differently; whole texts are hashed, of any length.  Columns beyond the five do not enter.
    An empty table gives an empty result.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(changed, leaf(*values[:3], F.col("n_chars") + 1, values[4]))
    leaves = docs.select("doc_id", "lang", leaf(*values).alias("leaf"), tampered.alias("tampered"))
    proved = manifest(leaves, "lang", ["doc_id"])
    folded = fold(digest_text(F.coalesce("tampered", "leaf")), F.col("witness"))
    return proved.select(
        "doc_id", *[digest_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        proof_digest(F.col("witness")).alias("proof_sha256"), folded.alias("folded_root"), "witness",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

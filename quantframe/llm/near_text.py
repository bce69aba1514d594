"""N-gram Jaccard self-join by a prefix filter over an inverted index.

This is not T-occurrence search with DivideSkip: no lists are heap-merged and none is probed.  A document is
the set of its distinct word shingles.  Two sets of sizes a and b reach the Jaccard threshold only if they
share T(a, b) shingles.  The inverted lists are divided into *long* ones (shingles found in very many sets) and
*short* ones.  A set that must share T of its n shingles shares one of its first n - T + 1 in any fixed order; the
order here puts all short lists before the long ones, so the lists that are met are short unless nearly
the whole document is made of frequent passages.  A candidate's exact overlap is counted by binary search of the
smaller set in the larger one.

A list is never expanded into all its pairs.  First every member is held against the list's most
central member (the one with the fewest rare shingles) and a few others; linked sets become components; then
those outside a list's largest component meet the members of *other* components, which is still exact for the components: a pair that is left out
has both ends in one component already.

Where every link is asked for, those left out are counted without a row a pair: sets that share a component and
lie in lists with left-out pairs are packed into blocks of near sizes, and two blocks meet as two matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.arrow import chunks, lists, texts
from quantframe.llm.graph import components
from quantframe.llm.sources import files_for, travelling
from quantframe.session import staged

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Text whose shingles a task holds at a time, and bytes of whole sets that it gathers for a write.
TEXT_BYTES, GATHERED = 2 << 20, 16 << 20
#: Bits of the bitmap that tells most unlike pairs apart.
PARITY = 2048
#: Members of a list that all others meet before only those of different components do.
LEADERS = 32
PACKED = "part int, tokens binary, nodes binary, places binary"
#: Sets of a block, bytes of its shingles, and shingles that a matrix of it holds at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 4 << 20, 4096
#: At most this many lists are called long, so that the set of them can be sent to every task.
MOST_LONG = 1 << 20


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than asked for give one shingle.

    A-Z are lower-cased, words are separated by blank and U+0009 to U+000D only.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    words = min(words, len(tokens))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    total = len(tokens) - words + 1
    out = np.full(total, words, np.uint64)
    for k in range(words):
        out = (out ^ (out >> np.uint64(29))) * MIX_A + hashed[k : k + total] * MIX_B
    out ^= out >> np.uint64(32)
    out *= MIX_A
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _prefix(n: int, num: int, den: int) -> int:
    """How many shingles of a set, in the common order, must hold one that any partner shares."""
    return n - (-(-num * n // den)) + 1


def _signer(words: int, num: int, den: int, long_lists):
    """Sets with the part of them that is indexed: short lists first, then the long ones."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", TEXT_BYTES):
            sizes, keys, heads, tails, rare = [], [], [], [], []
            for text in texts(batch):
                s = shingles(text, words)
                at = np.searchsorted(long_lists.value, s)
                is_long = long_lists.value[np.minimum(at, len(long_lists.value) - 1)] == s
                take, short = _prefix(len(s), num, den) if len(s) else 0, s[~is_long]
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                heads.append(short[:take].view(np.int64))
                tails.append(s[is_long][: max(take - len(short), 0)].view(np.int64))
                rare.append(len(short))
            columns = {"doc_id": batch.column(0), "n": pa.array(sizes, pa.int64()), "sig": pa.array(keys, pa.binary()), "rare": pa.array(rare, pa.int64())}
            yield pa.record_batch({**columns, "head": lists(heads, pa.int64()), "tail": lists(tails, pa.int64())})

    return sign


def _frequent(words: int, parts: int):
    """Shingles found twice or more in four megabytes of text, with their count, packed by index part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 * TEXT_BYTES):
            tokens, n = np.unique(np.concatenate([shingles(t, words) for t in texts(batch)]), return_counts=True)
            tokens, n = tokens[n > 1], n[n > 1]
            part = ((tokens >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(int(p), tokens[order[cut[p] : cut[p + 1]]].tobytes(), n[order[cut[p] : cut[p + 1]]].astype(np.int64).tobytes(), b"") for p in np.flatnonzero(np.diff(cut))]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.binary()] * 3))], names=["part", "tokens", "nodes", "places"])

    return run


def _split(head: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a batch with their row and place, in the order of the index part that they belong to."""
    token = head.flatten().to_numpy().view(np.uint64)
    sizes = head.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    part = ((token >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return token[order], row[order], place[order], np.searchsorted(part[order], np.arange(parts + 1))


def _packed(parts: int):
    """Inverted lists of a batch as one packed row for each index part: far less to move than a row a posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, (token, row, place, cut) = batch.column(0).to_numpy(), _split(batch.column(1), parts)
            node, place = node[row], place.astype(np.int32)
            found = np.flatnonzero(np.diff(cut))
            columns = ([v[cut[p] : cut[p + 1]].tobytes() for p in found] for v in (token, node, place))
            yield pa.record_batch([pa.array(found, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "tokens", "nodes", "places"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pieces = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))]
    for batch in batches:
        for row in zip(batch.column(1), batch.column(2), batch.column(3)):
            pieces.append(tuple(np.frombuffer(v.as_buffer(), k) for v, k in zip(row, (np.uint64, np.int64, np.int32))))
    return tuple(np.concatenate(c) for c in zip(*pieces))


def _long_ones(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, n, _ = _unpacked(batches)
        tokens, at = np.unique(token, return_inverse=True)
        yield pa.record_batch({"token": pa.array(tokens[np.bincount(at, n, len(tokens)) > most].view(np.int64))})

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the lists that hold two sets or more."""
    token, node, place = _unpacked(batches)
    order = np.argsort(token, kind="stable")
    token, node, place = token[order], node[order], place[order]
    same = token[1:] == token[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(token) else np.empty(0, bool)
    _, at, members = np.unique(token, return_inverse=True, return_counts=True)
    yield pa.record_batch({"token": pa.array(token[keep].view(np.int64)), "node": pa.array(node[keep]), "pos": pa.array(place[keep]), "members": pa.array(members[at][keep])})


def _parity(s: np.ndarray) -> bytes:
    """A bitmap in which every shingle flips one bit: two bitmaps differ in no more bits than the sets in shingles."""
    flips = np.bincount((s >> np.uint64(7)).astype(np.int64) % PARITY, minlength=PARITY)
    return np.packbits((flips & 1).astype(bool)).tobytes()


def _sets(words: int):
    """Whole sets of the classes that are asked for; a repeated doc_id may bring another text, which is left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", TEXT_BYTES):
            found = [shingles(t, words) for t in texts(batch)]
            bags = [s.tobytes() for s in found]
            meant = [xxhash.xxh3_128_digest(bag) == sig for bag, sig in zip(bags, batch.column(1).to_pylist())]
            out = {"node": batch.column(2), "n": pa.array([len(s) for s in found], pa.int64()), "bits": pa.array([_parity(s) for s in found], pa.binary()), "bag": pa.array(bags, pa.binary())}
            yield pa.record_batch(out).filter(pa.array(meant, pa.bool_()))

    return make


def _may_reach(num: int, den: int):
    """Pairs whose bitmaps do not already show too many different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PARITY // 8) for i in (4, 5))
            different = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = (num + den) * different <= (den - num) * both
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep))

    return run


def _overlaps(num: int, den: int):
    """Pairs that share enough: the smaller of two sorted sets is looked up in the other by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append((num + den) * int((y[at] == x).sum()) >= num * (len(x) + len(y)))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep, pa.bool_()))

    return run


def _shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles every set of ``left`` shares with every set of ``right``: a product of two 0/1 matrices, by runs of columns."""
    owners = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    tokens = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*tokens)
    out = np.zeros((len(left), len(right)), np.int64)
    places = []
    for token, owner in zip(tokens, owners):
        at = np.searchsorted(both, token)
        found = at < len(both)
        found[found] = both[at[found]] == token[found]
        order = np.argsort(at[found], kind="stable")
        places.append((at[found][order], owner[found][order]))
    for start in range(0, len(both), COLUMNS):
        halves = []
        for (at, owner), side in zip(places, (left, right)):
            a, b = np.searchsorted(at, (start, start + COLUMNS))
            half = np.zeros((len(side), COLUMNS), np.float32)
            half[owner[a:b], at[a:b] - start] = 1
            halves.append(half)
        out += (halves[0] @ halves[1].T).astype(np.int64)
    return out


def _block_links(num: int, den: int):
    """Links of every set of two blocks to sets of the other; a block that meets itself is one of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                nodes, sets = ([np.array(row[i].as_py(), np.int64) for i in (0, 2)], [[np.frombuffer(v.as_buffer(), np.uint64) for v in row[i]] for i in (1, 3)])
                sizes = [np.array([len(s) for s in side], np.int64) for side in sets]
                linked = (num + den) * _shared_sizes(*sets) >= num * (sizes[0][:, None] + sizes[1][None, :])
                linked &= nodes[0][:, None] != nodes[1][None, :]
                ends = [(nodes[0], linked.sum(1))] if row[4].as_py() else [(nodes[0], linked.sum(1)), (nodes[1], linked.sum(0))]
                node, n = (np.concatenate(c) for c in zip(*ends))
                yield pa.record_batch({"node": pa.array(node), "class_links": pa.array(n.astype(np.int64))}).filter(pa.array(n > 0))

    return run


class _Join:
    """The state of one self-join: classes of equal sets, their inverted lists and the links found."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        self.docs, self.words, self.num, self.den = docs, words, num, den
        spark = docs.sparkSession
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        most = max(32, docs.agg(F.sum(F.length("text") / 5)).first()[0] or 0) / MOST_LONG
        counted = docs.select("text").mapInArrow(_frequent(words, self.parts), PACKED).repartitionById(self.parts, F.col("part"))
        # a text has fewer words than a fifth of its length only where words are very long: at most MOST_LONG lists or so
        found = np.array([r[0] for r in counted.mapInArrow(_long_ones(max(32, int(most) + 1)), "token long").collect()], np.int64)
        long_lists = spark.sparkContext.broadcast(np.append(np.sort(found.view(np.uint64)), np.uint64(2**64 - 1)))
        signed = docs.mapInArrow(_signer(words, num, den, long_lists), "doc_id long, n long, sig binary, rare long, head array<long>, tail array<long>")
        self.base = staged(signed)
        full = self.base.where("n > 0")
        # equal sets are one class, so copies never meet as pairs
        grouped = full.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "rare", "head", "tail")])
        self.classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()))
        # only where a doc_id stands for several rows can a class be met twice when texts are read again
        self.repeated = self.base.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
        self.bags: DataFrame | None = None

    def postings(self) -> DataFrame:
        """``(token, node, n, pos, guide, crowded)`` of all lists with at least two sets.

        Guides are the list's most central member and about LEADERS others, the same in every list that has them,
        by hash, so few different pairs arise; in a list of LEADERS or fewer all are; longer lists are crowded.
        The index is cut by token into parts of some two million postings.  Lists that are long come as plain
        rows, which any number of tasks can share.
        """
        total = self.classes.agg(F.sum(F.size("head"))).first()[0] or 0
        parts = max(self.parts, total // 2_000_000 + 1)
        packed = self.classes.select("node", "head").mapInArrow(_packed(parts), PACKED)
        rows = packed.repartitionById(parts, F.col("part")).mapInArrow(_shared, "token long, node long, pos int, members long")
        tails = self.classes.where(F.size("tail") > 0).select("node", F.size("head").alias("before"), F.posexplode("tail").alias("i", "token"))
        tails = staged(tails.select("token", "node", (F.col("before") + F.col("i")).alias("pos")))
        sizes = tails.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        rows = rows.unionByName(tails.join(sizes, "token"))
        rows = staged(rows.join(self.classes.select("node", "n", "rare"), "node"))
        big = rows.where(F.col("members") > LEADERS)
        heads = big.groupBy("token").agg(F.min(F.struct("rare", "n", "node")).alias("c")).select("token", F.col("c.node").alias("centre"))
        chosen = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("members") < F.lit(LEADERS << 20)
        big = big.join(heads, "token").select("token", "node", "n", "pos", ((F.col("node") == F.col("centre")) | chosen).alias("guide"), F.lit(True).alias("crowded"))
        few = rows.where(F.col("members") <= LEADERS).select("token", "node", "n", "pos", F.lit(True).alias("guide"), F.lit(False).alias("crowded"))
        return few.unionByName(staged(big))

    def _enough(self, a: str, b: str) -> str:
        """Size and position filters of a pair: the overlap can still reach T."""
        return (
            f"{self.den} * least({a}.n, {b}.n) >= {self.num} * greatest({a}.n, {b}.n) and "
            f"{self.num + self.den} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {self.num} * ({a}.n + {b}.n)"
        )

    def _load(self, nodes: DataFrame) -> None:
        """Keep the whole sets of classes; the texts of those not yet kept are read for it."""
        if self.bags is not None:
            nodes = nodes.join(self.bags.select("node"), "node", "left_anti")
        keys = staged(self.classes.select("sig", "node", F.col("doc_id").alias("id")).join(nodes, "node", "left_semi"))
        wanted = self.docs.join(keys, self.docs["doc_id"].eqNullSafe(keys["id"])).select("text", "sig", "node")
        bags = wanted.mapInArrow(_sets(self.words), "node long, n long, bits binary, bag binary")
        bags = staged(bags.dropDuplicates(["node"]) if self.repeated else bags, row_group=GATHERED)
        self.bags = bags if self.bags is None else self.bags.unionByName(bags)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose exact overlap reaches the threshold."""
        self._load(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())

        def with_both(frame: DataFrame, column: str) -> DataFrame:
            for end in ("a", "b"):
                frame = frame.join(self.bags.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col(column).alias(f"x_{end}")), end)
            return frame

        bits = with_both(pairs, "bits").select("a", "b", "n_a", "n_b", "x_a", "x_b")
        likely = staged(bits.mapInArrow(_may_reach(self.num, self.den), "a long, b long"))
        return staged(with_both(likely, "bag").select("a", "b", "x_a", "x_b").mapInArrow(_overlaps(self.num, self.den), "a long, b long"))

    def led(self, marked: DataFrame) -> DataFrame:
        """Pairs of every list's members with its guides."""
        return self._met(marked, marked.where("guide"), "l.node <> r.node and (not l.guide or l.node < r.node)")

    def across(self, marked: DataFrame, found: DataFrame) -> DataFrame:
        """The other pairs of one list that ``found`` has not linked: all but its largest component meet the list."""
        near = components(found).select(F.col("id").alias("node"), "component")
        told = marked.where("not guide").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = told.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        told = staged(told.join(split.select("token"), "token"))
        sizes = told.groupBy("token", "component").count()
        largest = sizes.groupBy("token").agg(F.max(F.struct("count", "component")).alias("m"))
        right = told.join(largest.select("token", F.col("m.component").alias("main")), "token")
        return self._met(right.where("component <> main"), right, "l.component <> r.component and (r.component = r.main or l.node < r.node)")

    def degrees(self, marked: DataFrame, found: DataFrame, whole: DataFrame) -> DataFrame:
        """``(node, class_links)``: links of every set, those of ``found`` and those that it did not take to find the components.

        A list of at most LEADERS members was tried whole, so a link that is missing has both ends in longer lists and, as
        all links do, in one component.  These sets are cut by component and size (a step of sizes is the threshold, so a
        link reaches the next step at most) into blocks, and blocks meet once.
        """
        crowd = staged(marked.where("crowded").select("node").distinct().join(whole, "node"))
        crowd = crowd.join(crowd.groupBy("component").count().where("count > 1").select("component"), "component")
        ratio = float(np.log(self.den / self.num)) if self.num < self.den else 1.0
        # sizes of one link differ by the ratio at most: half a step more keeps the rounding of logarithms away
        step = F.floor(F.log("n") / F.lit(ratio * 1.5)).cast("int") if self.num < self.den else F.col("n").cast("int")
        sets = staged(self.bags.join(crowd, "node").select("component", step.alias("step"), "node", "bag"), row_group=GATHERED)
        sizes = sets.groupBy("component", "step").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.length("bag")).alias("bytes"))
        parts = F.ceil(F.greatest(F.col("sets") / F.lit(BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
        sizes = staged(sizes.select("component", "step", parts.alias("parts")))
        dealt = sets.join(sizes, ["component", "step"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        blocks = dealt.groupBy("component", "step", "part").agg(F.collect_list(F.struct("node", "bag")).alias("held"))
        blocks = staged(blocks.select("component", "step", "part", F.col("held.node").alias("nodes"), F.col("held.bag").alias("bags")), row_group=GATHERED)
        names = blocks.select("component", "step", "part")
        left, right = (names.select("component", F.col("step").alias(f"step_{e}"), F.col("part").alias(f"part_{e}")) for e in "lr")
        near = "(step_l = step_r and part_l <= part_r) or step_r = step_l + 1"
        met = left.join(right, "component").where(near).withColumn("itself", F.expr("step_l = step_r and part_l = part_r"))
        for e in "lr":
            side = blocks.withColumnsRenamed({"step": f"step_{e}", "part": f"part_{e}", "nodes": f"nodes_{e}", "bags": f"bags_{e}"})
            met = met.join(side, ["component", f"step_{e}", f"part_{e}"])
        counted = met.select("nodes_l", "bags_l", "nodes_r", "bags_r", "itself").mapInArrow(_block_links(self.num, self.den), "node long, class_links long")
        known = found
        for end in ("a", "b"):
            known = known.join(crowd.select(F.col("node").alias(end), F.lit(True).alias(f"crowd_{end}")), end, "left")
        known = known.where("crowd_a is null or crowd_b is null")
        ends = known.select(F.col("a").alias("node")).unionAll(known.select("b")).withColumn("class_links", F.lit(1).cast("long"))
        return counted.unionAll(ends).groupBy("node").agg(F.sum("class_links").alias("class_links"))

    def _met(self, left: DataFrame, right: DataFrame, where: str) -> DataFrame:
        met = left.alias("l").join(right.alias("r"), "token").where(F.expr(f"{where} and {self._enough('l', 'r')}"))
        return met.selectExpr("least(l.node, r.node) as a", "greatest(l.node, r.node) as b").distinct()


def jaccard_components(
    docs: DataFrame, words: int = 3, numerator: int = 90, denominator: int = 100, every_link: bool = True
) -> DataFrame:
    """Classes of documents joined by shingle sets with Jaccard >= numerator / denominator.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Returns one row per input row:
    ``doc_id, n_shingles, component_id`` (smallest doc_id reachable by links, itself included) and
    ``class_links`` (links from the document's set to other sets; without ``every_link`` only those that it took
    to find the components).  A null or empty text, or one without words, has the empty set and
    links with nothing.  Repeated rows are copies.  A null doc_id takes part but never names a
    component unless it stands alone.  Hashes of 64 bits stand for shingles, 128 bits for whole sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = _Join(docs, words, numerator, denominator)
    marked = work.postings()
    tried = staged(work.led(marked))
    every = work.links(tried)
    rest = staged(work.across(marked, every).join(tried, ["a", "b"], "left_anti"))
    every = every.unionByName(work.links(rest))
    whole = components(every).select(F.col("id").alias("node"), "component")

    if every_link:
        whole = staged(whole)
        degree = work.degrees(marked, every, whole)
    else:
        degree = every.select(F.col("a").alias("node")).unionAll(every.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("class_links"))
    named = work.classes.select("node", "sig", "doc_id").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "component").join(degree, "node", "left").select("sig", "component_id", F.coalesce("class_links", F.lit(0).cast("long")).alias("class_links"))
    out = work.base.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    out = out.join(named, "sig", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("class_links", F.lit(0).cast("long")).alias("class_links"),
    )


def keep_one(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id.

    Documents without words all stay, and so do rows that share the kept doc_id.
    """
    found = jaccard_components(docs, words, numerator, denominator, every_link=False)
    kept = F.col("doc_id").isNull() | (F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id"))
    rows = found.groupBy("doc_id").agg(F.max(kept.cast("int")).alias("kept"))
    gone = travelling(staged(rows.where("kept = 0").select("doc_id"), files=files_for(docs)))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

"""Byte-level BPE by DuckDB recursive queries inside each partition.

A task cuts its texts into pre-tokens, and the distinct ones that it has not met yet become
token-position rows.  A recursive query joins neighbouring rows with the merge table and contracts, in
every word, the pair of the lowest rank from the left until no pair is left.  A step does not stop at that
one pair.  A pair may be contracted ahead of its turn if nothing of a lower rank can touch its two tokens
before.  Such a merge makes a token that holds the pair itself, the pair on its left or that on its right, so it
is enough that none of the three can be inside a token of a lower rank (``floor``: the rank that the two make
together, or the lowest of a token that holds them next to the byte that stands before or behind them, a property
of the vocabulary).  The number of steps then grows with the depth of a word's merges rather than with its
length.  Pairs of a token with itself overlap; of a run of them every second one is taken.
Ids are turned back into bytes by an ordered aggregation over the vocabulary.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.arrow import chunks, texts
from quantframe.llm.tokens import read_ranks

#: Text handled at a time, and words remembered with their ids in a worker.
CHUNK, REMEMBERED = 4 << 20, 1_000_000
#: Bytes of new words that a query contracts at a time; one longer word is alone.
WORD_BYTES = 1 << 18

ENCODE = """
with recursive t(pos, word, id, head, tail) using key (pos) as (
  select pos, word, id, byte, byte from started
  union
  (with live as (
     select r.pos, r.word, r.id, r.head, row_number() over w as nth, lead(r.id) over w as next_id, lead(r.word) over w as next_word,
       lead(r.pos) over w as next_pos, lead(r.tail) over w as next_tail, lag(r.word) over w as word_before, lag(r.tail) over w as byte_before,
       lead(r.word, 2) over w as word_behind, lead(r.head, 2) over w as byte_behind
     from recurring.t r semi join t on r.word = t.word where r.id >= 0
     window w as (order by r.pos)),
   met as (
     select live.word, live.pos, live.nth, live.next_pos, live.head, live.next_tail, m.id, m.alone, live.id = live.next_id as twin,
       case when word_before = word then m.pair * 512 + byte_before end as before,
       case when word_behind = word then m.pair * 512 + 256 + byte_behind end as behind
     from live join near m on live.id = m.l and live.next_id = m.r where live.word = live.next_word),
   bound as (
     select met.*, least(met.id, x.rank, y.rank) as floor from met left join inside x on before = x.key left join inside y on behind = y.key),
   fit as (
     select *, lag(nth) over w as nth_left, lag(id) over w as id_left, lag(floor) over w as floor_left,
       lead(nth) over w as nth_right, lead(floor) over w as floor_right
     from bound window w as (order by pos)),
   place as (
     select word, pos, nth, next_pos, head, next_tail, id, alone, twin,
       coalesce(nth_left = nth - 1 and id_left = id, false) as tied,
       coalesce(nth_left = nth - 1 and floor_left <= id, false) as held_left,
       floor < id or coalesce(nth_right = nth + 1 and floor_right < id, false) as held
     from fit where id is not null),
   best as (select word, min((id::bigint << 36) | pos) as least from place group by word),
   ranked as (
     select place.*, place.id = (least >> 36) as least_id, place.pos = (least & 68719476735) as first
     from place join best on place.word = best.word),
   open as (select * from ranked where not twin and ((not held and not held_left) or (least_id and (first or not alone and not tied)))),
   twins as (select *, nth - row_number() over (order by pos) as run from ranked where twin),
   runs as (
     select *, row_number() over w as turn, first_value(held_left) over w as run_held
     from twins window w as (partition by run, word, id order by pos)),
   chosen as (
     select pos, next_pos, word, id, head, next_tail from open
     union all
     select pos, next_pos, word, id, head, next_tail from runs where case when least_id then case when alone then first else turn % 2 = 1 end else turn % 2 = 1 and not held and not run_held end)
   select pos, word, id, head, next_tail from chosen union all select next_pos, word, -1, null, null from chosen)
)
select word, id from t where id >= 0 order by pos
"""

DECODE = """
select doc, string_agg(v.chars, '' order by pos) as chars from coded join vocabulary v using (id) group by doc
"""


@functools.cache
def _splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def merge_table(ranks: dict[bytes, int]) -> tuple[dict[str, list], dict[str, list]]:
    """Two tables of the vocabulary.

    ``pair, l, r, id, alone``: tokens that stand side by side in some token and the token that they make (null:
    none); ``alone``: some token made from ``id`` has a lower rank, so it must be looked for after each merge.
    ``key, rank``: the lowest rank of a token that holds a pair with a certain byte before it (``pair`` * 512 +
    byte) or behind it (256 more), where it is below that of the pair's own token.
    """
    merged = {
        (ranks[token[:k]], ranks[token[k:]]): rank
        for token, rank in ranks.items()
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    }
    before = {part for pair, rank in merged.items() for part in pair if rank < part}
    numbers: dict[tuple[int, int], int] = {pair: i for i, pair in enumerate(merged)}
    inside: dict[int, int] = {}
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        size = len(token)
        for k in range(1, size):
            left = [(s, i) for s in range(k) if (i := ranks.get(token[s:k])) is not None]
            right = [(e, i) for e in range(k + 1, size + 1) if (i := ranks.get(token[k:e])) is not None]
            for (s, x), (e, y) in itertools.product(left, right):
                if rank < merged.get((x, y), rank + 1):
                    key = numbers.setdefault((x, y), len(numbers)) * 512
                    if s:
                        inside.setdefault(key + token[s - 1], rank)
                    if e < size:
                        inside.setdefault(key + 256 + token[e], rank)
    ids = [merged.get(pair) for pair in numbers]
    left, right = [x for x, _ in numbers], [y for _, y in numbers]
    near = {"pair": list(numbers.values()), "l": left, "r": right, "id": ids, "alone": [i in before for i in ids]}
    return near, {"key": list(inside), "rank": list(inside.values())}


class _Coder:
    """One in-memory DuckDB connection per worker, with the vocabulary and the words met so far."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        pairs, holders = map(pa.table, merge_table(self.ranks))  # noqa: F841
        self.db.execute("create table near as select pair, l::int l, r::int r, id::int id, alone from pairs")
        self.db.execute("create table inside as select key, rank::int rank from holders")
        # one character, U+0000 to U+00FF, for each byte
        vocabulary = pa.table({"id": list(self.ranks.values()), "chars": [t.decode("latin-1") for t in self.ranks]})
        self.db.execute("create table vocabulary as select id::int id, chars from vocabulary")
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        """Words met so far and where their ids lie."""
        self.known: dict[str, int] = {}
        self.start, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, words: set[str]) -> None:
        """Ids of new words; a word that is a token itself is that token."""
        if len(self.known) > REMEMBERED:
            self.forget()
        todo, whole = [], []
        for word in words - self.known.keys():
            data = word.encode("utf-8", "surrogatepass")
            (whole if data in self.ranks else todo).append((word, data))
        self._remember([w for w, _ in whole], np.ones(len(whole), np.int64), np.array([self.ranks[d] for _, d in whole], np.int64))
        ends = np.cumsum([len(d) for _, d in todo])
        start = 0
        while start < len(todo):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + WORD_BYTES, side="right")))
            self._contract(todo[start:stop])
            start = stop

    def _contract(self, todo: list[tuple[str, bytes]]) -> None:
        sizes = np.array([len(d) for _, d in todo])
        word = np.repeat(np.arange(len(todo), dtype=np.int32), sizes)
        data = np.frombuffer(b"".join(d for _, d in todo), np.uint8)
        started = pa.table({"pos": np.arange(len(data), dtype=np.int32), "word": word, "id": self.first[data], "byte": data})  # noqa: F841
        done = self.db.sql(ENCODE).to_arrow_table()
        self._remember([w for w, _ in todo], np.bincount(done.column("word").to_numpy(), minlength=len(todo)), done.column("id").to_numpy())

    def _remember(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        start = len(self.flat) + np.cumsum(sizes) - sizes
        self.known.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def encode(self, pieces: list[list[str]]) -> list[np.ndarray]:
        self.learn(set().union(*pieces))
        counts = [len(doc) for doc in pieces]
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, sum(counts))
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum(counts)[:-1]]
        return np.split(ids, cuts)

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        sizes = [len(d) for d in docs]
        coded = pa.table(  # noqa: F841
            {
                "doc": np.repeat(np.arange(len(docs), dtype=np.int32), sizes),
                "pos": np.arange(sum(sizes), dtype=np.int32),
                "id": np.concatenate([*docs, np.empty(0, np.uint32)]).astype(np.int32),
            }
        )
        found = dict(self.db.execute(DECODE).fetchall())
        return [found.get(i, "").encode("latin-1") for i in range(len(docs))]


@functools.cache
def _coder(path: str) -> _Coder:
    return _Coder(path)


def _coded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = _coder(path), _splitter(pattern)
        for batch in chunks(batches, "text", CHUNK):
            ids = coder.encode([split.findall(t) for t in texts(batch)])
            decoded = coder.decode(ids)
            blobs = [i.astype("<u4").tobytes() for i in ids]
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                    "ids": pa.array(blobs, pa.binary()),
                    "decoded": pa.array(decoded, pa.binary()),
                }
            )

    return run


def encode_decode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row of ``docs(doc_id, text)``.

    ``ids``: the token ids as little-endian unsigned 32-bit integers; ``decoded``: the bytes they stand for.
    ``rank_path`` is a file of token bytes and ranks at the same place on every machine.  Special tokens
    are ordinary text.  A null or empty text has no ids.  Rows are independent; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_coded(rank_path, pattern), "doc_id long, n_tokens long, ids binary, decoded binary")

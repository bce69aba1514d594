"""WARC archives and their globally ordered capture index.

Pages become WARC records (a payload that occurred before is a revisit) in volumes of bounded size that
Spark's text writer puts into the shared folder.  Reading a volume back gives one locally sorted run of
index entries; runs are dealt to key ranges and merged there by a loser tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.arrow import chunks
from quantframe.session import shared_dir, staged

CRLF = b"\r\n"
#: Bytes of records after which a volume is closed; a longer record has its volume nearly alone.
VOLUME = 8 << 20
#: Capture times count seconds from here, one for each page id, where a page brings no time of its own.
EPOCH = 1_600_000_000
HEADER = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*(.*?)\r$")


def url_key(url: Column) -> Column:
    """Sort-friendly URL: host labels reversed, then path and query, in lower case; no scheme, port or fragment."""
    text = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""))
    host = F.regexp_extract(text, r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(text, r"^[a-z][a-z0-9+.\-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [v.as_buffer() or b"" for v in batch.column(1)]
        digest = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
        sizes = pa.array([len(p) for p in payloads], pa.int64())
        yield pa.record_batch({"page_id": batch.column(0), "payload_bytes": sizes, "digest": pa.array(digest)})


def _record(page: int | None, url: str, size: int, digest: str, refers: int | None, first: bool, html: str) -> str:
    """One record without its last line end, which the text writer adds."""
    clean = re.sub(r"[\r\n]", "", url)
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = answer + html if first else answer
    seconds = pd.Timestamp(EPOCH + (page or 0), unit="s").strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {seconds}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block.encode('utf-8', 'surrogatepass'))}",
    ]
    if not first:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    volume, filled = 0, 0
    for batch in chunks(batches, "html", 4 << 20):
        made, at = [], []
        for row in batch.to_pylist():
            text = _record(row["page_id"], row["url"], row["payload_bytes"], row["digest"], row["refers_to"], row["first"], row["html"])
            if filled and filled + len(text) > VOLUME:
                volume, filled = volume + 1, 0
            filled += len(text)
            made.append(text)
            at.append(volume)
        yield pa.record_batch({"volume": pa.array(at, pa.int64()), "record": pa.array(made)})


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as WARC volumes under ``path``.

    Of equal payloads the smallest page_id is the response and the others are revisits that refer to it
    (a null page_id counts as larger than any); among rows that repeat that page_id with the same payload
    all are responses.  A null html is an empty payload, a null url an empty one.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("url_key", url_key(F.col("url")))
    facts = pages.select("page_id", F.col("html").cast("binary").alias("html")).mapInArrow(_digests, "page_id long, payload_bytes long, digest string")
    facts = staged(facts.distinct())
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    decided = staged(facts.join(firsts, "digest").withColumn("first", F.col("page_id").eqNullSafe(F.col("refers_to"))))
    # a page id that is repeated with other payloads has several facts: the payload's own one is meant
    digest = F.pandas_udf(lambda s: s.map(lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()), "string")
    several = facts.groupBy("page_id").count().where("count > 1").limit(1).count()
    if several:
        pages = pages.withColumn("digest", digest(F.col("html").cast("binary")))
        joined = pages.join(decided.withColumnRenamed("page_id", "id"), (F.col("page_id").eqNullSafe(F.col("id"))) & (pages["digest"] == decided["digest"])).drop(decided["digest"])
    else:
        joined = pages.join(decided.withColumnRenamed("page_id", "id"), F.col("page_id").eqNullSafe(F.col("id")))
    rows = joined.select("page_id", "url", "url_key", "payload_bytes", "digest", "refers_to", "first", "html")
    records = rows.mapInArrow(_records, "volume long, record string").select("record", F.concat_ws("-", F.spark_partition_id(), "volume").alias("volume"))
    records.write.partitionBy("volume").option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse_volume(data: bytes) -> list[dict]:
    """Index entries of a volume, with the payload's digest checked against the record's bytes."""
    out, at = [], 0
    while at < len(data):
        head_end = data.index(CRLF + CRLF, at) + 4
        head = {k.lower(): v.decode("utf-8", "surrogatepass") for k, v in HEADER.findall(data[at : head_end - 2])}
        body_end = head_end + int(head[b"content-length"])
        block = data[head_end:body_end]
        http_end = block.index(CRLF + CRLF) + 4
        http = {k.lower(): v for k, v in HEADER.findall(block[: http_end - 2])}
        payload, kind = block[http_end:], head[b"warc-type"]
        digest = head[b"warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest:
                raise ValueError(f"payload of {head[b'warc-record-id']} does not match its digest")
        else:
            size = int(http[b"content-length"])
        page = head[b"warc-record-id"][len("<urn:page:") : -1]
        refers = head.get(b"warc-refers-to", "")[len("<urn:page:") : -1]
        out.append(
            {
                "page_id": int(page) if page else None,
                "captured": head[b"warc-date"],
                "url": head[b"warc-target-uri"],
                "payload_bytes": size,
                "payload_digest": digest,
                "record_type": kind,
                "refers_to": int(refers) if refers and refers != "None" else None,
                "record_offset": at,
                "record_length": body_end + 4 - at,
            }
        )
        at = body_end + 4
    return out


ENTRY = "page_id long, captured string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_offset long, record_length long, volume string"
INDEX = f"url_key string, {ENTRY}"


def _arrow(rows: list[dict], order: list[str], ints: tuple[str, ...]) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array([r[c] for r in rows], pa.int64() if c in ints else pa.string()) for c in order})


LONGS = ("page_id", "payload_bytes", "refers_to", "record_offset", "record_length")


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ENTRY.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows = [r | {"volume": path.as_py()} for r in parse_volume(gzip.decompress(content.as_py()))]
            yield _arrow(rows, names, LONGS)


def read_archives(spark, path: str) -> DataFrame:
    """Index entries of all volumes under ``path``; a volume is one input row of bounded size.

    Volumes are compressed; offsets count the bytes of the volume as it is without that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    entries = files.where("length > 0").select("path", "content").mapInArrow(_indexed, ENTRY)
    return entries.withColumn("url_key", url_key(F.col("url"))).select("url_key", *[c.split()[0] for c in ENTRY.split(", ")])


class LoserTree:
    """Merge of sorted runs: each inner node keeps the run that lost there, so a step replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for run in range(len(runs)):
            self._replay(run, building=True)

    def _beats(self, a: int, b: int) -> bool:
        """Does run ``a`` come before run ``b``; a run that is used up comes last, ties go by run number."""
        left, right = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        if not (left and right):
            return left or (not right and a < b)
        return (self.key(self.runs[a][self.at[a]]), a) < (self.key(self.runs[b][self.at[b]]), b)

    def _replay(self, run: int, building: bool = False) -> None:
        node = (run + self.size) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0 and building:
                self.losers[node] = run  # waits here for its rival
                return
            if rival >= 0 and self._beats(rival, run):
                self.losers[node], run = run, rival
            node //= 2
        self.losers[0] = run

    def __iter__(self):
        while self.runs and self.at[(win := self.losers[0])] < len(self.runs[win]):
            yield self.runs[win][self.at[win]]
            self.at[win] += 1
            self._replay(win)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one key range, each already in order, merged into one."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    runs: dict[str, list] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[-1], []).append(row)
    order = lambda row: (row[0], row[2], row[1] is None, row[1] or 0, row[8])  # noqa: E731  key, time, page, offset
    rows: list = []
    for row in LoserTree(list(runs.values()), order):
        rows.append(dict(zip(names, row)))
        if len(rows) == 4096:
            yield _arrow(rows, names, LONGS)
            rows = []
    yield _arrow(rows, names, LONGS)


def capture_index(entries: DataFrame) -> DataFrame:
    """Entries in one global order by URL key, time and page: partition by partition, row by row.

    Key ranges hold about equal shares because the time and page break ties of a URL with many captures.
    Within a range every volume's entries arrive as a sorted run, and a loser tree merges the runs.
    """
    n = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = entries.repartitionByRange(n, "url_key", "captured", "page_id")
    runs = ranged.sortWithinPartitions("volume", "url_key", "captured", F.col("page_id").asc_nulls_last(), "record_offset")
    return runs.mapInArrow(_merged, INDEX)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives, read them back, and return the ordered index.

    One row per input row; see ``write_archives`` for nulls, ties and repeated rows.  Other columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return capture_index(staged(read_archives(spark, path)))

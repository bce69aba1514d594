"""A keyed table that grows by batches: readers see a merged base and, over it, the batches since.

Folders of a table::

    open/batch_id=N        the rows of batch N, as they came
    base/version=V/bucket=B  rows of a hash bucket of the keys, newest per key, merged up to batch V
    manifest/V             which version holds each bucket

A merge rewrites only the buckets that the open batches touch and then writes one small manifest; a batch up to
the manifest's version is superseded and never read again.  Appending or merging again after a failure gives the same table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.operators.tables import last_write_wins

BATCH, BUCKET = "batch_id", "bucket"


def _folder(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it does not exist."""
    at, store = _folder(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, store = _folder(spark, path)
    store.delete(at, True)


def _read_text(spark: SparkSession, path: str) -> str:
    at, store = _folder(spark, path)
    stream = store.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at, store = _folder(spark, path)
    stream = store.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


@dataclass(frozen=True)
class MergedTable:
    """Rows by ``keys``, the newest batch's row of a key counts."""

    path: str
    keys: Sequence[str]
    schema: str
    buckets: int = 32

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> str:
        return f"{self.schema}, {BATCH} long"

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch; one row a key stands for repeated keys."""
        columns = rows.sparkSession.createDataFrame([], self.schema).columns
        rows = rows.select(*columns)
        rest = [c for c in columns if c not in self.keys]
        single = rows.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.keys, "_r.*")
        single.select(*columns).write.mode("overwrite").parquet(f"{self.path}/open/{BATCH}={batch_id}")

    def version(self, spark: SparkSession, before: int | None = None) -> int:
        """Last batch that is merged (before batch ``before``), -1 if none is."""
        merged = [int(n) for n in names(spark, f"{self.path}/manifest") if n.isdigit()]
        return max((v for v in merged if before is None or v < before), default=-1)

    def _base(self, spark: SparkSession, version: int) -> DataFrame:
        held = json.loads(_read_text(spark, f"{self.path}/manifest/{version}")) if version >= 0 else {}
        paths = [f"{self.path}/base/version={v}/{BUCKET}={b}" for b, v in held.items()]
        return spark.read.schema(self._stored()).parquet(*paths) if paths else spark.createDataFrame([], self._stored())

    def _open(self, spark: SparkSession, version: int, before: int | None) -> tuple[DataFrame, list[int]]:
        """The batches after ``version``, and their numbers."""
        written = [int(n.partition("=")[2]) for n in names(spark, f"{self.path}/open") if n.startswith(f"{BATCH}=")]
        batches = sorted(b for b in written if b > version and (before is None or b < before))
        rows = spark.createDataFrame([], self._stored())
        if batches:
            paths = [f"{self.path}/open/{BATCH}={b}" for b in batches]
            rows = spark.read.schema(self._stored()).option("basePath", f"{self.path}/open").parquet(*paths)
        return rows, batches

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Current rows; with ``before``, as they were before that batch."""
        version = self.version(spark, before)
        since, batches = self._open(spark, version, before)
        base = self._base(spark, version)
        if batches:
            since = last_write_wins(since, list(self.keys), [BATCH])
            base = base.join(since.select(*self.keys), list(self.keys), "left_anti").unionByName(since)
        return base.drop(BATCH)

    def merge(self, spark: SparkSession) -> None:
        """Merge the open batches into the buckets they touch."""
        version = self.version(spark)
        since, batches = self._open(spark, version, None)
        if not batches:
            return
        since = since.withColumn(BUCKET, self._bucket())
        touched = {r[0] for r in since.select(BUCKET).distinct().collect()}  # at most ``buckets`` numbers
        held = json.loads(_read_text(spark, f"{self.path}/manifest/{version}")) if version >= 0 else {}
        paths = [f"{self.path}/base/version={held[str(b)]}/{BUCKET}={b}" for b in sorted(touched) if str(b) in held]
        old = spark.read.schema(self._stored()).parquet(*paths) if paths else spark.createDataFrame([], self._stored())
        rows = since.unionByName(old.withColumn(BUCKET, self._bucket()))
        merged = last_write_wins(rows, [*self.keys, BUCKET], [BATCH])
        target = f"{self.path}/base/version={batches[-1]}"
        merged.write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        _write_text(spark, f"{self.path}/manifest/{batches[-1]}", json.dumps(held | {str(b): batches[-1] for b in sorted(touched)}))

    def drop_superseded(self, spark: SparkSession) -> None:
        """Delete merged batches and buckets that no reader of the current version opens."""
        version = self.version(spark)
        if version < 0:
            return
        held = json.loads(_read_text(spark, f"{self.path}/manifest/{version}"))
        for name in names(spark, f"{self.path}/open"):
            if name.startswith(f"{BATCH}=") and int(name.partition("=")[2]) <= version:
                remove(spark, f"{self.path}/open/{name}")
        for folder in names(spark, f"{self.path}/base"):
            for name in names(spark, f"{self.path}/base/{folder}"):
                if name.startswith(f"{BUCKET}=") and f"version={held.get(name.partition('=')[2])}" != folder:
                    remove(spark, f"{self.path}/base/{folder}/{name}")
        for name in names(spark, f"{self.path}/manifest"):
            if name.isdigit() and int(name) < version:
                remove(spark, f"{self.path}/manifest/{name}")

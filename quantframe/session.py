"""Session defaults and small session helpers."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quantframe", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(max(int(cores) if cores.isdigit() else 8, 1)))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # stack capture per column call is slow
        # a method above 8000 bytecodes is never compiled; wide feature projections run faster split up
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def split_wide(spark: SparkSession) -> None:
    """Projections over dozens of columns run as several methods: the JVM never compiles one above 8000 bytecodes.

    Narrower plans compile as before.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


_LOCAL_FOLDERS: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the session's checkpoint folder, or a local one in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.TemporaryDirectory(prefix="quantframe-")
    _LOCAL_FOLDERS.append(folder)  # removed when the process ends
    spark.conf.set("spark.checkpoint.dir", folder.name)
    return folder.name


def _stage_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}"


_SCOPE = contextvars.ContextVar("scope", default="frames")


@contextlib.contextmanager
def staging(scope: str) -> Iterator[None]:
    """Frames staged inside lie in a folder of their own, which ``clear_stage`` can remove alone."""
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def clear_stage(spark: SparkSession, scope: str | None = None) -> None:
    """Delete this application's staged frames (of one scope); call it when none of them is read any more."""
    root = _stage_root(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root if scope is None else f"{root}/{scope}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Frames staged inside are deleted at the end; what is to stay is staged by the function that this gives."""
    outer, scope = _SCOPE.get(), f"passing-{uuid.uuid4().hex}"

    def keep(df: DataFrame | Sequence[DataFrame], **options) -> DataFrame:
        with staging(outer):
            return staged(df, **options)

    try:
        with staging(scope):
            yield keep
    finally:
        clear_stage(spark, scope)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS: Counter[SparkSession] = Counter()
_GIVEN: dict[SparkSession, str] = {}
_LOCK = threading.Lock()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go with the end of each write, not when the driver next collects garbage.

    A written frame is read from where it lies, so nothing comes back to them.  Several threads may write at a time.
    """
    with _LOCK:
        if not _WRITERS[spark]:
            _GIVEN[spark] = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        _WRITERS[spark] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS[spark] -= 1
            if not _WRITERS[spark]:
                spark.conf.set(_CLEANUP, _GIVEN.pop(spark))
                del _WRITERS[spark]


def stored_bytes(df: DataFrame) -> int:
    """Size of what a plan reads, as the planner estimates it; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def staged(df: DataFrame | Sequence[DataFrame], files: int | None = None, row_group: int | None = None) -> DataFrame:
    """Write a frame that several branches or jobs read to the shared folder and read it back.

    Later readers scan only the columns they need, and a lost executor costs a re-read instead of
    a recomputation of everything upstream.  ``files``: how many at most, where the frame is known to be small.
    ``row_group``: bytes that a task holds before it writes them, for rows with large values.
    Several frames of the same columns are written one after the other and read as one.
    """
    frames = [df] if isinstance(df, DataFrame) else list(df)
    spark = frames[0].sparkSession
    path = f"{_stage_root(spark)}/{_SCOPE.get()}/{uuid.uuid4().hex}"
    for frame in frames:
        writer = (frame if files is None else frame.coalesce(files)).write.mode("append" if frame is not frames[0] else "error")
        with shuffles_dropped(spark):
            (writer if row_group is None else writer.option("parquet.block.size", row_group)).parquet(path)
    return spark.read.schema(frames[0].schema).parquet(path)

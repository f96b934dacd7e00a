"""Session helpers: the shared folder for checkpoints and run-scoped tables, and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Paths that ``written`` filled inside the innermost ``scratch``, if there is one.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)

#: Runtime settings of every job here. Wide casts generate methods the JVM never compiles when they
#: pass 8,000 bytes; below that limit Spark splits them into small ones instead.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with the runtime settings above."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: The most bytes of a shuffle, and of files, that a task of ``smaller_tasks`` reads.
SMALLER_TASKS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
    "spark.sql.files.maxPartitionBytes": 16 << 20,
}


@contextmanager
def smaller_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside are cut finer than Spark cuts them by size; settings that are finer still stay.

    A megabyte of records of short repeating texts stands for seconds of work. Spark's sizes make of them a few tasks more
    than there are cores, and the last ones leave most cores idle.
    """
    before = {key: spark.conf.get(key, None) for key in SMALLER_TASKS}
    for key, size in SMALLER_TASKS.items():
        if before[key] is None or in_bytes(before[key]) > size:
            spark.conf.set(key, str(size))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def in_bytes(size: str) -> int:
    """A size as Spark's settings state it: a number, with or without a unit."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)(?:i?b)?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    A temporary folder is used only by a local session that names none; a cluster session without
    the setting is refused, because a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        found = context._jsc.sc().getCheckpointDir()
        configured = found.get() if found.isDefined() else None
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(configured)
    return configured


def run_path(spark: SparkSession, name: str) -> str:
    """A new path of its own for one written table of one run."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so later reads all see the same ones."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows written as parquet under the shared folder and read back.

    Used where one table feeds many consumers: it is computed once and survives lost executors.
    """
    path = run_path(df.sparkSession, name)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, jobs: Mapping[str, Callable[[], T]]) -> dict[str, T]:
    """The results of jobs that run side by side: one's last tasks leave no core idle. Each has a thread."""
    if not jobs:
        return {}
    with ThreadPoolExecutor(len(jobs)) as pool:
        started = {
            name: pool.submit(copy_context().run, inheritable_thread_target(spark)(job)) for name, job in jobs.items()
        }
        return {name: job.result() for name, job in started.items()}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Drops, at its end, every table that ``written`` stored inside; its value writes tables that stay.

    Rows that are read after the end may only come from tables that stay.
    """
    paths: list[str] = []
    token = _SCRATCH.set(paths)

    def staying(df: DataFrame, name: str) -> DataFrame:
        found = written(df, name)
        paths.pop()
        return found

    try:
        yield staying
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            dropped(spark, path.rpartition("/")[0])


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a run's folder from the store that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table has no more than ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A lookup side hinted for broadcast only after its rows were counted, and plain beyond that.

    Used where the size is not known before planning (a written checkpoint), so that the large
    side is not shuffled first. The count stops one row beyond the bound.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def shuffled_side(df: DataFrame) -> DataFrame:
    """A side that is joined by a shuffle, however small its files are.

    Sorted ids compress to a few bytes a row, so the size of a stored table of events says little of what the driver
    would hold to broadcast it. Used for tables that grow with the records.
    """
    return df.hint("merge")

"""Session settings, the shared folder, and cutting lineage."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

def local_session(
    cores: int | str = "*",
    partitions: int = 8,
    name: str = "shelfloom",
    shared: str | None = None,
) -> SparkSession:
    """A one-machine session for tests and the benchmark; clusters bring their own.

    ``shared`` names the folder for intermediate data of this session.
    """
    builder = SparkSession.builder.master(f"local[{cores}]")
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return (
        builder
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting keeps its intermediate data beside its warehouse; a
    cluster without it is refused, because no folder can be assumed to be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"


_RUN: ContextVar[str | None] = ContextVar("run", default=None)
_RUNS = "runs"


@contextmanager
def run(spark: SparkSession, label: str) -> Iterator[str]:
    """What is materialised inside goes to a folder of this run, which goes when the run ends.

    The folder names its owner and when it was last used, so that ``sweep`` can tell abandoned runs.
    Results that outlive the run have to be written elsewhere before it ends.
    """
    folder = f"{shared_folder(spark)}/{_RUNS}/{label}-{uuid.uuid4().hex}"
    touch(spark, folder)
    held = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(held)
        remove(spark, folder)


def run_folder(spark: SparkSession) -> str:
    """Where intermediate data goes: the folder of the run, or the shared one outside of any."""
    folder = _RUN.get()
    if folder is None:
        return shared_folder(spark)
    touch(spark, folder)
    return folder


def touch(spark: SparkSession, folder: str) -> None:
    """Record that a run is at work."""
    path, system = _path(spark, f"{folder}/_owner")
    out = system.create(path, True)
    out.write(bytearray(spark.sparkContext.applicationId.encode()))
    out.close()


def sweep(spark: SparkSession, idle_seconds: float) -> list[str]:
    """Remove the folders of runs that were not at work for so long; those of this session stay.

    Choose an age beyond the longest step of any job that shares the folder.
    """
    now, gone = time.time() * 1000, []
    for owner in list_paths(spark, f"{shared_folder(spark)}/{_RUNS}/*/_owner"):
        path, system = _path(spark, owner)
        folder = owner.rpartition("/")[0]
        own = _RUN.get()
        mine = own is not None and folder.endswith(own.rpartition("/")[2])
        if not mine and now - system.getFileStatus(path).getModificationTime() > idle_seconds * 1000:
            remove(spark, folder)
            gone.append(folder)
    return gone


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all it holds, if it is there."""
    path, system = _path(spark, folder)
    system.delete(path, True)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, by: str | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written rows.

    Used where a step must run exactly once (a model call) or where its result feeds several
    branches. The files outlive lost executors, keep column pruning, and carry sizes that the
    optimizer can use to choose a join. ``by`` names a column to lay the files out by, so that
    readers of one value skip the others. Texts take a third less room in zstd than in Spark's default.
    ``free`` removes the shuffle files of this write as it ends, not when the driver next collects garbage.
    """
    path = f"{run_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = (df.write.partitionBy(by) if by else df.write).option("compression", "zstd")
    conf = df.sparkSession.conf
    held = conf.get(_FREE, "false")
    if free:
        conf.set(_FREE, "true")
    try:
        writer.parquet(path)
    finally:
        if free:
            conf.set(_FREE, held)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_counted(
    df: DataFrame, label: str, counts: dict[str, Column], by: str | None = None
) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates over the rows that the same write has seen, by their names.

    They are observed as the rows pass, so no second job reads the rows to count them.
    """
    seen = Observation()
    written = materialise(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), label, by)
    return written, seen.get


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob on whatever file system the pattern names, sorted."""
    path, system = _path(spark, pattern)
    found = system.globStatus(path)
    return sorted(status.getPath().toString() for status in (found or []))


def files_below(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files at any depth below a folder; none if it does not exist."""
    path, system = _path(spark, folder)
    if not system.exists(path):
        return []
    found, files = [], system.listFiles(path, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return found

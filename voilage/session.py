"""Session set-up, and the shared folder that intermediate results go to."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "voilage", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` set.

    Only a session whose executors are threads of this process may fall back to a folder of
    this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _folder_of_this_machine()


_folders: list[str] = []


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[str]:
    """Tables written inside the block go to one folder, which is deleted at its end.

    They may hold what a job suppresses, such as the counts of small classes. Write or collect
    what is wanted inside the block: frames that read these tables end with it.
    """
    path = f"{shared_folder(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    _folders.append(path)
    try:
        yield path
    finally:
        _folders.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@functools.cache
def _folder_of_this_machine() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is written yet."""
    folder = _folders[-1] if _folders else shared_folder(spark)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, limit: int = 64) -> DataFrame:
    """Deal out the rows of a table that has fewer splits than there are cores.

    Few files, or files that cannot be split, would keep most cores idle. A table with
    enough splits, so any large one, is returned as it is and not shuffled.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, limit)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a checkpointed frame, the written table carries its true size and
    prunes columns, and it outlives any executor.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

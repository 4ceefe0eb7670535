"""Session helpers: nothing here overrides what a cluster has already set."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes the shuffle files of a query once it has run. Else they stay until the driver happens to collect its garbage,
#: which it does by its own heap, whatever the executors' disks hold.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own. ``shared`` becomes the checkpoint folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; without one, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors can read and write")
    return root.rstrip("/")


#: Tables that ``durable`` has written for each call of ``settled`` that has begun.
_made: list[list[DataFrame]] = []


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files, unless the session says otherwise."""
    if spark.conf.get(CLEANUP, None) is not None:
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: write once to the shared folder and read the table back.

    Survives lost executors, computes its input once and gives later joins real sizes. The table
    stays until ``discard`` is called on the frame returned here; the shuffle files that it took go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stage = path
    if _made:
        _made[-1].append(back)
    return back


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``durable(make())``, and the stage tables that ``make`` has written on the way are deleted."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        out = durable(make())
    finally:
        _made.pop()
    discard(*(frame for frame in made if frame is not out))
    if _made:
        _made[-1].append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``durable`` returned, once everything read from them is written."""
    for frame in frames:
        path = getattr(frame, "_stage", None)
        if path:
            target = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(target, True)

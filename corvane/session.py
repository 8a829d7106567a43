"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "8", name: str = "corvane") -> SparkSession:
    """Session for tests and the bench. A cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and driver and executors are one process, which is the
    case for local tests. It goes when that process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        base = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path for one run's table under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corvane/{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the data is written to the shared folder, so a lost
    executor costs a re-read, not a replay of the whole iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps whose tables are no longer held, which Spark otherwise removes when its driver happens to
    collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows up to which the small side of ``join_small`` is broadcast.
SMALL_ROWS = 1_000_000


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins a huge table with a table that has one row per key.

    The small side is written and counted first. Up to ``SMALL_ROWS`` rows it is broadcast, so the huge side stays where it is,
    however few keys it has; beyond that there are many keys and an ordinary join spreads them.
    """
    small = cut_lineage(small)
    return df.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small, on, how)


def default_buckets(spark: SparkSession) -> int:
    """Bucket count for two-level ordered operators, tied to the cluster's parallelism."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

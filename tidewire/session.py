"""Session helpers: a local session for tests and bench, and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidewire", cpus: str | None = None) -> SparkSession:
    """A local session for tests and bench. On a cluster, use the session you are given."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEWIRE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, seen by every machine.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder name inside the shared folder."""
    _SCRATCH.append(f"{shared_folder(spark).rstrip('/')}/tidewire-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this driver has made, once no result reads them any more.

    Returns how many there were. Results are lazy, so only the caller knows when that is.
    """
    jvm, n = spark._jvm, 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Session settings the operators are tuned for, and the shared scratch folder.

Nothing here sizes a plan by hand: AQE coalesces and splits shuffle partitions,
skewed join keys are split at run time, and a join side is broadcast only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "confluo", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the engine's settings; keyword dots are ``__``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a one-process ``local[…]`` session that names none (a unit test) gets a folder of its
    own, recorded in the session; a cluster without a shared folder is an error, since what
    one executor writes to its own disk no other can read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("confluo.scratch.dir", None)
    if not root:
        shared = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = shared.get() if shared.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="confluo-")
        spark.conf.set("confluo.scratch.dir", root)
    return root.rstrip("/")


_OPEN: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder, deleted when the ``scratch_scope`` around it ends, or
    else when the driver's JVM does."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    held = _OPEN.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was written to scratch inside: for work whose results are written
    to their own place by then, such as a micro-batch."""
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in paths:
            drop_scratch(spark, path)


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch_path`` that nothing reads any more."""
    files, at = file_system(spark, path)
    files.delete(at, True)


def own_exchange(df: DataFrame) -> DataFrame:
    """Give a lookup table that was aggregated by its key an exchange of its own in the join.

    An aggregate leaves its rows partitioned by the key, a join on that key then reuses the
    partitioning, and Spark splits the hot keys of the *other* side only between two exchanges.
    The table has a row per key, so moving it once more costs little.
    """
    return df.hint("rebalance")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where a scan has fewer splits than there are cores.

    For costly work on each row of a few large files or row groups, which one task would do
    alone. A table with a split per core, as any large one has, is read as it is, and so is
    what comes out of an exchange.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative plans, survives lost executors, and gives the optimizer
    the true size of the result, so later joins choose broadcast or shuffle by measurement.
    """
    path = scratch_path(df.sparkSession, label)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)

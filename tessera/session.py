"""Session building and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session built here. Partition sizes follow Spark's advisory sizes, so the same plan
#: holds from one node to a large cluster; on a cluster the submitter's settings take precedence.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench. It never overrides a running session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=DEFAULTS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Where it is unset and the master is local, a temporary folder takes its place. On a cluster without
    the setting this raises: a folder of one machine would lose data with that machine.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there; its lineage ends here.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files once the result is no longer referred to.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes that travel to Python at once, unless the session has a bound of its own.

    The bound is the same for all operators, so it doesn't matter which of them ran last, and very long texts travel alone.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(2 << 20))

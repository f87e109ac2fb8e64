"""Session construction for tests and benches; on a cluster the caller's own session is used."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "harrow") -> SparkSession:
    """A local session with the settings that the operators assume (AQE, Arrow, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def checkpointed(df):
    """Cut lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is that of ``spark.checkpoint.dir``. Where it is unset a local session (tests,
    benches) gets a temporary folder; on a cluster, whose executors could not read each other's
    local files, it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="harrow-checkpoint-"))
    return df.checkpoint(eager=True)


def released(spark):
    """Have the files of shuffles and checkpoints that nothing refers to any more deleted now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

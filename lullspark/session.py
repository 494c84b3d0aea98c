"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import posixpath

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lullspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; pass ``conf`` to override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Call-site capture asks the JVM several times per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, taken from ``spark.checkpoint.dir``.

    Unset, it is a folder of the warehouse, which all executors share as well; on a cluster
    whose warehouse is a folder of one machine it must be set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not context.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = posixpath.join(warehouse, "_checkpoints")
    context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives lost executors."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_up_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles whose results have been written.

    It does so when the driver collects its garbage, which may take hours otherwise.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()

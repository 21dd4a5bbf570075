"""Session helpers: reliable lineage cuts and the settings the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def single_machine(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is not."""
    return master == "local" or master.startswith("local[")


def local_session(cores: int | str = 8, name: str = "evalloom", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a scratch folder of its own; on a
    cluster a missing setting is an error, because another machine could not read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
        if shared is None:
            if not single_machine(context.master):
                raise ValueError(f"{CHECKPOINT_KEY} must name a folder all executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that several actions read; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder, or in /tmp on a local master."""
    shared = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if shared is not None:
        return f"{shared.rstrip('/')}/evalloom-{uuid.uuid4().hex}"
    if not single_machine(spark.sparkContext.master):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")

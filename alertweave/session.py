"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Tasks of a large shuffle for each core, so that a core that is done early gets another one.
TASKS_PER_CORE = 4


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on (UTC, adaptive execution)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # By default a shuffle of any size is joined to one task for each core, or few more, which
    # then run in two uneven rounds. Partitions under 1 MB are joined as before.
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(tasks))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``, which all executors share.

    Only a session in local mode may go without; it gets a temporary folder. On a cluster a
    folder of the driver's machine would be lost to the executors, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(shared)


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("alertweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "localhost")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the call site of every column expression makes building plans slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Sorted series compress well, so a shuffled MB is many MB of a task's memory: tasks are made
    # small, from more partitions than the usual 200, and merged where there is little data.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "800",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidebook")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``.  A temporary folder is made
    only where nothing is set and driver and tasks are one process; on a cluster
    that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


_CHEAP = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "Range"}


def is_scan(df: DataFrame) -> bool:
    """True when the plan's nodes only read, project and filter, so reading it twice is cheap."""
    node = df._jdf.queryExecution().optimizedPlan()
    while True:
        if node.nodeName().split(" ")[0] not in _CHEAP:
            return False
        if node.children().isEmpty():
            return True
        node = node.children().head()


def staged(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once as a table in the shared folder.

    For a result that is read more than once: the upstream work is done one
    time, survives the loss of executors, and readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

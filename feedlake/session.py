"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "feedlake", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with the settings every job expects.

    ``shuffle_partitions`` is the number of partitions a shuffle starts with; adaptive execution merges the small
    ones. On a cluster take the bytes of the largest shuffle divided by 128 MB, and not less than the cores.
    Streaming state lives in RocksDB, outside the executors' heap.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The section tree is walked with a recursive CTE; its size is the table's, not a fixed number of rows.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one in the session's warehouse.

    Both are shared by the driver and all executors; a machine's own temporary folder is never used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/feedlake-steps"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder for one run of a job."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    A lost executor then repeats a read instead of the steps before, and later joins know the real size. The
    files stay until the shared folder is cleaned, as a task that is retried may still need them.
    """
    path = run_folder(df.sparkSession, "step")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

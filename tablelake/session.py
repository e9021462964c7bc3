"""Session settings the library relies on, and shared-folder materialisation."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings: they can be applied to a session somebody else built.
RUNTIME_CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Cell and page rows are small on disk but costly to work on: keep them spread out.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows handed to Python can be whole pages, so batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # Spark 4.1 can repeat rows when a join relies on the partitioning it infers for a union.
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to an existing session."""
    for key, value in RUNTIME_CONFS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "tablelake", master: str | None = None, **confs: str) -> SparkSession:
    """A session for scripts and tests; on a cluster, pass the submitted one instead."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONFS, **confs}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder executors and driver share (`spark.checkpoint.dir`).

    Only a local-mode session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablelake-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` to the shared folder once and read it back.

    Cuts lineage without executor-local storage, so a lost executor costs a
    re-read, and gives Catalyst real file sizes: a small result is then
    broadcast by the optimizer's own size check, a large one is not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

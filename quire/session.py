"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Only settings that change correctness or the handling of skew; sizes belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # so many asked keys of the store reach the files' statistics and bloom filters one by one
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # whole books travel to the Arrow fallbacks, so a batch holds few of them
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def build_session(app: str = "quire", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quire-package-"), "quire.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "quire")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    context._quire_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the cluster's shared one, else a local one for tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df):
    """Materialise in the shared checkpoint folder, so that a lost executor does not redo the past."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a table of few files over all cores, for work that costs far more than their bytes.

    A file of one row group is read by one task, however many rows it has. Rows of at least as many files as there are
    cores stay where they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(4 * cores)

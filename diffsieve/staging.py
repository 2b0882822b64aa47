"""Cutting lineage for tables that several branches of a review read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark takes away a query's shuffle files at its end, not only when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir`` (shared storage, so a lost executor costs
    nothing). Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="diffsieve-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stage(df: DataFrame, clean: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from the table.

    Readers of the table fetch only the columns they need. With ``clean`` the shuffle files of the writing go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true" if clean else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)

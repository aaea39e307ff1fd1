"""The folder for checkpoints that the cluster shares, and tables that are settled there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where nothing is set and the master is local (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meshframe-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and so do estimates. A checkpoint keeps the
    estimated size of its plan; in a loop of joins these multiply until planning a round costs more than running it."""
    path = f"{shared_dir(df.sparkSession)}/work/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``settled``, and joined by shuffles. Spark broadcasts a table whose files look small, through the driver, and files of ids
    take a small part of what their rows take: many such joins send the driver more than it can hold."""
    return settled(df).hint("merge")

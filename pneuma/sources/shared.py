"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under the session's checkpoint folder; without one, a temporary one on a local master, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """rows written to a new shared folder and read again: what follows neither computes nor plans what came before."""
    path = shared_folder(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

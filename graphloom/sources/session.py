"""Session settings that operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """The cluster names the shared checkpoint folder; one is set only where none is, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints/graphloom")

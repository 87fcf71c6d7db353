"""Rows dealt to the partitions of a table's scan, by files in a folder that all tasks reach.

A task that reads partition p of the table again finds there what was dealt to p, so texts need not
be shuffled to meet it. The table must give the same rows in the same partitions each time (a scan,
a checkpoint). The files are Spark's own output, so only those of finished jobs are ever read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row's number is its partition's times this, and its place there.
ROWS_BITS = 33


def filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def deal(rows: DataFrame, folder: str, *order: str, spread: tuple[str, ...] = ()) -> None:
    """Writes ``rows`` (with ``scan``, the partition's number) so that each partition has a folder of its own.

    Rows of partition -1 are for the driver; they are spread by the columns ``spread``.
    """
    salt = [F.when(F.col("scan") < 0, F.xxhash64(*spread))] if spread else []
    rows.repartition("scan", *salt).sortWithinPartitions("scan", *order).write.partitionBy("scan").parquet(folder)


def dealt_to(folder: str, scan: int | None = None) -> pa.Table | None:
    """What was dealt to a partition (the running task's, unless named), null if nothing was."""
    files, root = filesystem(folder)
    path = f"{root}/scan={TaskContext.get().partitionId() if scan is None else scan}"
    if files.get_file_info(path).type.name == "NotFound":
        return None
    return pq.read_table(path, filesystem=files, partitioning=None, use_threads=False, pre_buffer=False)

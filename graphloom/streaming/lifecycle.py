"""The task-event fold as a stream, and the watchdog for tasks that stall."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators import events
from graphloom.sources.session import ensure_checkpoints


def fold(stream: DataFrame, folder: str) -> str:
    """Runs ``events.lifecycle`` over all that the stream has now; returns the folder of the result.

    The fold is built-in aggregates, so state stays in the JVM and partial sums precede the shuffle.
    """
    result = f"{folder}/result"

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(result)

    query = events.lifecycle(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    return result


def stalled(stream: DataFrame, after_ms: int = 30_000) -> DataFrame:
    """A stream of ``id``, ``last_seq`` of tasks that were announced, aren't done, and stayed silent for ``after_ms``."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.getOption
            state.remove()
            if last is not None:
                yield pd.DataFrame({"id": [key[0]], "last_seq": [last[0]]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        if rows["event"].iloc[-1] == "Done":
            if state.exists:
                state.remove()
            return
        state.update((int(rows["seq"].iloc[-1]),))
        state.setTimeoutDuration(after_ms)

    return stream.select("id", "seq", "event").groupBy("id").applyInPandasWithState(watch, "id long, last_seq long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def lifecycle_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch query's fold, from the events table read as a stream of files."""
    from graphloom.sources.fixtures import RULES, dialect

    ensure_checkpoints(spark)
    table = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table.replace("events.parquet", "events.parque[t]"))
    stream = spark.sql(dialect(RULES["task_events"], "spark"), events=raw)
    return spark.read.parquet(fold(stream, f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"))

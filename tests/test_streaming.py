import time

from graphloom.streaming import lifecycle


def test_silent_tasks_are_reported_and_finished_ones_are_not(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, seq long, event string"
    spark.createDataFrame([(1, 1, "Pending"), (1, 2, "Running"), (2, 3, "Running"), (2, 4, "Done"), (3, 5, "Pending")], schema).coalesce(1).write.parquet(source)
    watched = lifecycle.stalled(spark.readStream.schema(schema).parquet(source), after_ms=1_000)
    query = watched.writeStream.format("memory").queryName("stalled_tasks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and spark.table("stalled_tasks").count() < 2:
            time.sleep(0.5)
        assert {tuple(r) for r in spark.table("stalled_tasks").collect()} == {(1, 2), (3, 5)}
    finally:
        query.stop()

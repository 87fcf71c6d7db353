from graphloom.operators import retention


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_slots(spark):
    entries = spark.createDataFrame([("a/k/x", 5, 1), ("a/k/y", 50, 2), ("a/z", 1, 4), ("b/x", 1, 8), ("b/y", 2, 16), ("c/x", 1, 32), ("c/y", 99, 64), ("bare", 1, 128), (None, 1, 1)], "path string, mtime long, bytes long")
    usage = spark.createDataFrame([("a/k", 3), ("gone", 1), ("a/z", 10), (None, 0)], "id string, last_used long")
    assert rows(retention.expired_slots(entries, usage, 10)) == {("a/k", 3, 3), ("b", 2, 24), ("bare", 1, 128)}
    assert rows(retention.expired_slots(entries.limit(0), usage, 10)) == set()
    assert rows(retention.expired_slots(entries, usage.limit(0), 2)) == {("bare", 1, 128)}


def test_traces(spark):
    traces = spark.createDataFrame([("s", "t1", 1), ("s", "t2", 9), ("v", "t3", 9), ("n", "t4", 1)], "scope string, trace string, mtime long")
    scopes = spark.createDataFrame([("s", "/s"), ("v", "/v"), ("e", "/s"), ("n", None)], "scope string, path string")
    existing = spark.createDataFrame([("/s",)], "path string")
    assert rows(retention.expired_traces(traces, scopes, existing, 5)) == {("v", None), ("e", None), ("s", "t1"), ("n", "t4")}
    assert rows(retention.expired_traces(traces.limit(0), scopes.limit(0), existing, 5)) == set()

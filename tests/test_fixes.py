"""Rules that were once wrong: null keys, empty selections, conflicts, running totals."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.operators import events, selection, store, trees


def test_hits_of_null_keys(spark):
    calls = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "a", None), (4, "a", "x"), (5, "a", None)], "seq long, k string, l string")
    got = {r["seq"]: r["result"] for r in store.hits(calls, ["k", "l"]).collect()}
    assert got == {1: "miss", 2: "hit", 3: "miss", 4: "miss", 5: "hit"}


def test_no_selectors_leave_all_changes(spark):
    changed = spark.createDataFrame([("//a:a",), ("//b:b",)], "address string")
    labels = spark.createDataFrame([], "address string, id long, is_primary boolean")
    assert selection.changed_scope(changed, labels, []).count() == 2
    with pytest.raises(selection.SelectorError):
        selection.parse("///a")


def test_merge_raises_on_conflicts(spark):
    tree = lambda rows: spark.createDataFrame(rows, "path string, digest string, size long")
    one = tree([("a/x", "1", 1), ("b", "2", 2)])
    assert {tuple(r) for r in trees.merge([one, tree([("b", "2", 2), ("c", "3", 3)])]).collect()} == {("a/x", "1", 1), ("b", "2", 2), ("c", "3", 3)}
    for other in ([("b", "9", 9)], [("b/c", "3", 3)], [("a", "3", 3)]):
        with pytest.raises(PySparkException, match="differ"):
            trees.merge([one, tree(other)]).collect()


def test_running_sums_over_runs(spark, monkeypatch):
    monkeypatch.setattr(store, "RUN", 4)
    rows = spark.createDataFrame([(i, "Pending" if i % 3 else "Done", None if i % 2 else "s") for i in range(30)], "seq long, event string, slot string")
    got = {r["seq"]: (r["total"], r["done"]) for r in events.progress(rows).collect()}
    assert got == {i: (sum(j % 3 > 0 for j in range(i + 1)), sum(j % 3 == 0 for j in range(i + 1))) for i in range(30)}
    of = {r["seq"]: r["n"] for r in store.running(rows, {"n": F.lit(1)}, ["slot"]).collect()}
    assert of == {i: i // 2 + 1 for i in range(30)}


def test_only_what_is_asked_for_is_raised_to_one(spark):
    rows = spark.createDataFrame([(0, 5), (None, 0), (None, None), (3, 0)], "a long, c long")
    assert [r[0] for r in rows.select(store.effective(F.col("a"), F.col("c"))).collect()] == [1, 0, 1, 3]


def test_interned_calls_share_the_first(spark):
    calls = spark.createDataFrame([(1, None, True), (2, None, True), (3, "a", True), (4, "a", False), (5, "a", True)], "seq long, k string, cache boolean")
    assert {r["seq"]: r["instance"] for r in store.interned(calls, ["k"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}

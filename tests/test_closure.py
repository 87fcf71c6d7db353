import pytest

from graphloom.plans import closure


def test_multiplicity_counts_paths_of_any_length(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("d", "e"), ("a", "d")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {(r["root"], r["leaf"]): r["ways"] for r in closure.multiplicity(df).collect()}
    assert got == {**{(x, x): 1 for x in "abcde"}, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 3, ("a", "e"): 6, ("b", "d"): 1, ("b", "e"): 2, ("c", "d"): 1, ("c", "e"): 2, ("d", "e"): 2}
    assert closure.multiplicity(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        closure.multiplicity(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def test_on_cycles_leaves_out_what_lies_between(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7), (8, 9), (9, 10), (10, 8), (10, 11), (11, 9), (12, 1)]
    assert {r["id"] for r in closure.on_cycles(pairs(spark, edges)).collect()} == {1, 2, 4, 5, 7, 8, 9, 10, 11}
    assert closure.on_cycles(pairs(spark, [(1, 2), (2, 3)])).count() == 0


def test_levels_of_a_cycle_end(spark):
    df = pairs(spark, [(1, 2), (2, 3), (3, 1)])
    with pytest.raises(ValueError, match="cycle"):
        closure.levels(df.selectExpr("src as id"), df)


def test_reachable_over_many_levels(spark, monkeypatch):
    monkeypatch.setattr(closure, "COMPACT", 3)
    df = pairs(spark, [(i, i + 1) for i in range(12)] + [(12, 3)])
    assert {r["id"] for r in closure.reachable(df, spark.range(2, 3)).collect()} == set(range(2, 13))

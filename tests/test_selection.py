import pytest

from graphloom.operators.selection import SelectorError, parse, select_labels, select_roots, split_facet
from graphloom.plans import closure


def addresses(spark, selector, found, base=""):
    df = spark.createDataFrame([(a,) for a in found], "address string")
    return {r[0] for r in df.where(parse(selector, base).matches()).collect()}


CATALOG = ["//library/jodin:jodin", "//library/jodin:tests", "//library/jodin/internal:helper", "//:pkg", "//library:lib"]


@pytest.mark.parametrize(
    ("selector", "base", "want"),
    [
        ("library/jodin", "", {"//library/jodin:jodin", "//library/jodin:tests"}),
        ("jodin", "", set()),
        (":pkg", "", {"//:pkg"}),
        ("//lib/...", "", set()),
        ("//library/...", "", set(CATALOG) - {"//:pkg"}),
        ("//...", "", set(CATALOG)),
        ("...", "library/jodin", {"//library/jodin:jodin", "//library/jodin:tests", "//library/jodin/internal:helper"}),
        ("../../library:lib", "library/jodin", {"//library:lib"}),
    ],
)
def test_selector_matrix(spark, selector, base, want):
    assert addresses(spark, selector, CATALOG, base) == want


@pytest.mark.parametrize("selector", ["", "a:", "a:b:c", "a:b/c", "/a", "../../x", "a/.../b"])
def test_bad_selectors(selector):
    with pytest.raises(SelectorError):
        parse(selector, "pkg")


def test_facets():
    assert split_facet("//pkg@asan") == ("//pkg", "asan")
    assert split_facet("//pkg") == ("//pkg", None)
    for bad in ("@x", "//pkg@", "//pkg@a/b"):
        with pytest.raises(SelectorError):
            split_facet(bad)


def test_default_roots_hide_others(spark):
    roots = spark.createDataFrame([("//pkg", "test", "unit", True), ("//pkg", "test", "asan", True), ("//pkg:library", "test", None, False)], "address string, workflow string, facet string, is_default boolean")
    assert {r["facet"] for r in select_roots(roots, "//pkg").collect()} == {"unit", "asan"}
    assert select_roots(roots, "//pkg@asan").count() == 1
    assert select_roots(roots, "//pkg:library").count() == 1


def test_labels_keep_the_first_address(spark):
    labels = spark.createDataFrame([("//pkg:aliased", 3), ("//pkg:also_aliased", 3), ("//a:x", 1)], "address string, id int")
    assert {tuple(r) for r in select_labels(labels, ["//pkg", "//..."]).collect()} == {(3, "//pkg:aliased"), (1, "//a:x")}


def test_closure_ends_on_cycles_and_levels_raise(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(2,)], "id long")
    assert {r[0] for r in closure.reachable(edges, seeds).collect()} == {1, 2, 3, 4}
    assert {r[0] for r in closure.on_cycles(edges).collect()} == {1, 2, 3}
    assert closure.reachable(edges, seeds.limit(0)).count() == 0
    with pytest.raises(ValueError):
        closure.levels(edges.selectExpr("src as id"), edges, most_levels=20)

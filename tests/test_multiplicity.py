import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from graphloom.plans import closure, multiplicity


def kept_bytes(spark):
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def by_loops(edges):
    after = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    found, nodes = {}, {x for e in edges for x in e}

    def of(x):
        if x not in found:
            found[x] = Counter({x: 1})
            for y in after[x]:
                found[x] += of(y)
        return found[x]

    return {(x, y): n for x in nodes for y, n in of(x).items()}


def test_all_paths_of_layers_stay_small_on_disk(spark):
    edges = [(f"layer{k}:{a}", f"layer{k + 1}:{b}") for k in range(3) for a in range(150) for b in range(150)]
    df = spark.createDataFrame(edges, "src string, dst string")
    spark.range(1).checkpoint()
    before = kept_bytes(spark)
    paths = closure.multiplicity(df)
    assert kept_bytes(spark) - before < 600_000  # 135,600 rows
    assert paths.count() == 6 * 150 * 150 + 600
    assert {tuple(r) for r in paths.groupBy("ways").count().collect()} == {(1, 3 * 22500 + 600), (150, 2 * 22500), (22500, 22500)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_paths_of_many_lengths_equal_loops(spark, monkeypatch, kind):
    monkeypatch.setattr(multiplicity, "RANGE_NODES", 9)  # a chunk each
    monkeypatch.setattr(multiplicity, "PART_EDGES", 11)
    monkeypatch.setattr(multiplicity, "STEP", 8)  # the driver's: so many messages a part
    rng = random.Random(5)
    edges = [(a, b) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(130))]
    edges += edges[:9] + [(a, 59) for a in range(40)] + [(0, b) for b in range(20, 50)]
    of = int if kind == "long" else "n{:02d}".format
    edges = [(of(a), of(b)) for a, b in edges]
    df = spark.createDataFrame([*edges, (of(70), None), (None, of(71))], f"src {kind}, dst {kind}")
    got = [tuple(r) for r in closure.multiplicity(df).select("root", "leaf", "ways").collect()]
    assert len(got) == len({g[:2] for g in got})
    assert {g[:2]: g[2] for g in got} == by_loops(edges) | {(of(x), of(x)): 1 for x in (70, 71)}


def test_lists_come_back():
    rng = np.random.default_rng(3)
    place = np.sort(rng.integers(-5, 5, 400)) * 10**15
    place, at, ways = multiplicity.added(place, rng.integers(0, 1 << 20, 400), rng.choice([1, 1, 2, 200, 2**62], 400))
    node, leaves, more, counts = multiplicity.packed(place, at, ways)
    (data, sizes), (many, _) = multiplicity._bytes(leaves), multiplicity._bytes(more)
    again = multiplicity.entries(data, sizes, many)
    assert np.array_equal(again[0], at) and np.array_equal(again[1], ways) and np.array_equal(again[2], counts)
    assert np.array_equal(np.repeat(node, counts), place)
    assert np.array_equal(multiplicity.numbers(multiplicity.places(np.arange(99) << 33)), np.arange(99) << 33)


def test_too_many_paths_raise():
    with pytest.raises(OverflowError, match="paths"):
        multiplicity.added(np.array([1, 1]), np.array([3, 3]), np.array([2**62, 2**62]))


def test_files_are_merged_in_order():
    def rows(*lists):
        for chunk, node, at in lists:
            _, leaves, more, _ = multiplicity.packed(np.full(len(at), node), np.array(at), np.ones(len(at), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([node]), leaves, more], names=["chunk", "place", "leaves", "more"])

    streams = [rows((0, -7, [1, 2]), (0, 4, [3]), (2, 1, [9])), rows((0, 4, [3, 5]), (1, 8, [0])), rows()]
    got = [(c, n, a, w) for c, *of in multiplicity._merged(streams) for n, a, w in zip(*(x.tolist() for x in of), strict=True)]
    assert got == [(0, -7, 1, 1), (0, -7, 2, 1), (0, 4, 3, 2), (0, 4, 5, 1), (1, 8, 0, 1), (2, 1, 9, 1)]

"""The suffix tree against one built from dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, suffix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = None


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def tree_scores(rows, depth, least_count, least_divergence):
    """Base and tree scores of each row (text, train) and the number of states, by the definitions alone."""
    known, followers = Counter(), {}
    learned = [tokens(text) for text, train in rows if train]
    for line in learned:
        known.update(line)
    total = sum(known.values())
    followers[()] = known
    counted = {(): None}
    states = {()}
    for k in range(1, depth + 1):
        found = {}
        for line in learned:
            for i in range(k, len(line)):
                c = tuple(line[i - k : i])
                if c[:-1] in counted and c[1:] in states and (k == 1 or len(followers[c[1:]]) > 1):
                    found.setdefault(c, Counter())[line[i]] += 1
        for c, after in found.items():
            n, kinds = sum(after.values()), len(after)
            if n < least_count:
                continue
            counted[c], followers[c] = True, after
            gain = 0.0
            for w, a in after.items():
                q = followers[c[1:]][w] / sum(followers[c[1:]].values())
                gain += math.log((kinds - 1) / (n + kinds - 2)) if a == 1 else a * math.log((a - 1 + kinds * q) / ((n - 1 + kinds) * q))
            if gain >= least_divergence * n:
                states.add(c)
    out = []
    for text, _ in rows:
        line, base, tree = tokens(text), 0.0, 0.0
        for i, w in enumerate(line):
            p = (known[w] + 0.1) / (total + 0.1 * (len(known) + 1))
            base += math.log10(p)
            for k in range(1, min(i, depth) + 1):
                c = tuple(line[i - k : i])
                if c not in states:
                    break
                n, kinds = sum(followers[c].values()), len(followers[c])
                p = (followers[c][w] + kinds * p) / (n + kinds)
            tree += math.log10(p)
        out.append((base, tree))
    return out, len(states)


def corpus(seed):
    rng = random.Random(seed)
    letters = "a b c d e f g".split()
    follow = {x: rng.sample(letters, 3) for x in letters}
    rows = []
    for i in range(60):
        line = [rng.choice(letters)]
        for _ in range(rng.randrange(60)):
            line.append(rng.choice(follow.get(line[-1], letters)) if rng.random() < 0.8 else rng.choice([*letters, f"rare{rng.randrange(40)}"]))
        rows.append((" ".join(line), i % 7 > 0))
    twin = " ".join(f"Unique{i}" for i in range(30))
    return rows + [(twin, True), (twin.upper(), True), (twin, False), (None, True), ("", False), (" \t\n", True), ("a b " * 500, True), ("a b", None)]


@pytest.mark.parametrize(("hot_count", "depth", "least_count", "least_divergence"), [(1 << 18, 4, 2, 0.02), (20, 4, 2, 0.02), (40, 6, 3, 0.1), (1 << 18, 1, 5, 0.0)])
def test_equals_the_tree_of_dictionaries(spark, monkeypatch, hot_count, depth, least_count, least_divergence):
    queries.prepare(spark)
    monkeypatch.setattr(suffix_tree, "HOT_COUNT", hot_count)
    monkeypatch.setattr(suffix_tree, "BLOCK", 700)
    rows = corpus(depth)
    want, states = tree_scores([(t, bool(train)) for t, train in rows], depth, least_count, least_divergence)
    assert states > 5
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, learn boolean").repartition(5, "doc_id").checkpoint()
    got = {r["doc_id"]: r for r in suffix_tree.score(df, F.col("learn"), depth, least_count, least_divergence).collect()}
    assert len(got) == len(rows)
    for i, (base, tree) in enumerate(want):
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] == pytest.approx(tree, rel=1e-9), rows[i]


def test_twins_are_scored_apart_and_states_grow(spark):
    rows = corpus(1)
    scores, few = tree_scores(rows[:20], 4, 2, 0.02)
    scores, many = tree_scores(rows, 4, 2, 0.02)
    assert many > few and scores[62][1] / 31 > -0.6 and scores[62][0] / 31 < -2


def test_base_model_and_edges(spark):
    queries.prepare(spark)
    rows = [(1, "The end the END ü"), (2, ""), (3, None), (None, "no id"), (4, "word " * 9000), (4, "word " * 9000), (10, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("scan", F.lit(1)).withColumn("train", F.lit("clash"))
    train = queries.crc_of_id(10) != 0
    known = Counter()
    for key, text in rows:
        if key is None or zlib.crc32(str(key).encode()) % 10:
            known.update(tokens(text))
    total = sum(known.values())
    got = suffix_tree.score(df, train).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {total}
    by_id = {r["doc_id"]: r for r in got}
    for key, text in rows:
        line = tokens(text)
        want = sum(math.log10((known[t] + 0.1) / (total + 0.1 * (len(known) + 1))) for t in line)
        assert by_id[key]["n_tokens"] == len(line) and by_id[key]["n_known"] == sum(known[t] > 0 for t in line)
        assert by_id[key]["base_score"] == pytest.approx(want, rel=1e-9)
    assert by_id[4]["score"] >= by_id[4]["base_score"] - 1e-9
    assert suffix_tree.score(df.limit(0), train).count() == 0
    assert {r["score"] for r in suffix_tree.score(df, F.lit(False)).where("n_tokens = 1").collect()} == {0.0}

"""Each operator on small tables with nulls, empty and long texts, ties, repeats, no rows and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, mixing, ngram_join, packing, quality_classifier, quality_rules, queries, textblocks, top_k, url_filters, warc
from graphloom.llm.textblocks import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
PROSE = " ".join(RNG.choice("the of stone river blue and Über wandering light\n a ,".split(" ")) for _ in range(400))
ROWS = [
    (1, PROSE, "en", "a", 1), (2, PROSE + " end", "en", "a", 1), (3, PROSE, "fr", "b", 1), (4, "", "en", None, 0), (5, None, None, None, None), (6, "one two three", "de", "c", 3),
    (6, "one two three", "de", "c", 3), (None, "no id here at all\n\nno id here at all", "xx", "c", 3), (7, " \t\n ", "en", "b", 4), (8, "word " * 9000, "en", "a", 2), (9, "#*$% && || <> Ünïcödé 漢字 <|endoftext|> " * 20, "es", "d", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    queries.prepare(spark)
    return spark.createDataFrame(ROWS, DOCS).withColumn("score", F.lit("clash")).withColumn("class", F.lit(1)).withColumn("node", F.lit("x"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (8, 0, 0), (9, 0, None), (99, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_url_filter(spark):
    queries.prepare(spark)
    urls = ["http://A.example.org/es/x?q", "x://example.org/en/12", None, "nothing", "http://com", "http://b.com/fr/", "http://c.net/a?ref=1", "http://c.net/a", "http://c.net/a", "http://C.net/b#x://y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("listed", F.lit("mine"))
    rows = url_filters.filter_urls(spark, pages, pages.where(F.col("url").rlike(queries.TRACKING)), queries.URL_RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert {r["listed"] for r in rows} == {"mine"}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("com", "", None, "allow")
    assert got[5] == ("b.com", "/fr/", "com/fr/", "allow")
    assert got[6][3] == got[7][3] == got[8][3] == "block" and got[9] == ("c.net", "/b", None, "allow")
    assert url_filters.filter_urls(spark, pages.limit(0), pages.limit(0), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("bits", [1 << 27, 600])
def test_cascade_is_exact(spark, monkeypatch, bits):
    queries.prepare(spark)
    monkeypatch.setattr(url_filters, "SHARD_BITS", bits)
    monkeypatch.setattr(url_filters, "SMALL_SHARD_BITS", bits)
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    cascade = url_filters.Cascade(keys, keys.where("key % 17 = 0"))
    assert (cascade.shards > 1) == (bits == 600)
    clashing = keys.unionByName(keys.where("key = 17")).withColumn("shard", F.lit("x")).withColumn("salt", F.lit("y")).withColumn("words", F.lit("z"))
    marked = cascade.mark(clashing, F.col("key"))
    assert marked.columns == [*clashing.columns, "listed"] and marked.count() == 3001
    assert marked.where("listed <> (key % 17 = 0) or shard <> 'x' or salt <> 'y' or words <> 'z'").count() == 0


def test_classifier(docs, labels, spark):
    network = quality_classifier.train(docs, labels, F.lit(True), per_class=5)
    scored = quality_classifier.score(docs, network).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    clashing = docs.withColumn("Quality_Score", F.lit(1.0)).withColumn("quality", F.lit("x"))
    kept = quality_classifier.keep_documents(clashing, labels, F.lit(True))
    assert kept.columns == clashing.columns and {r["Quality_Score"] for r in kept.collect()} <= {1.0}
    assert quality_classifier.score(docs.limit(0), network).count() == 0
    none = quality_classifier.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.train(docs, labels.where("quality = 1"), F.lit(True)).constant == 1.0


def test_classifier_covers_whole_texts():
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["river", "stone", "walk", "night", "blue"], 80)).encode() for _ in range(60)]
    bad = [b"".join(bytes(rng.integers(33, 48, 4).astype(np.uint8)) + b"!! " for _ in range(90)) for _ in range(60)]
    net = quality_classifier.fit([quality_classifier.chunks_of(t) for t in good + bad], np.repeat([1, 0], 60), steps=150)
    col = pa.array([t.decode() for t in good[:20] + bad[:20]])
    got = np.concatenate([net.scores(b.data, b.offsets) for b in blocks(col)])
    assert (got[:20] >= 0.5).all() and (got[20:] < 0.5).all()
    starts, _ = quality_classifier.chunk_starts(np.array([0, 5000]))
    covered = {i for s in starts for i in range(s, s + quality_classifier.CHUNK)}
    assert covered >= set(range(5000))


def random_network(seed):
    rng = np.random.default_rng(seed)
    q = quality_classifier
    return q.Network(rng.normal(0, 0.5, (257, q.EMBED)).astype(np.float32), rng.normal(0, 0.2, (q.WIDTH * q.EMBED, q.FILTERS)).astype(np.float32), rng.normal(0, 0.1, q.FILTERS).astype(np.float32), rng.normal(0, 0.3, q.FILTERS + 2), 0.1)


def plain_score(net, text):
    """The network by plain loops over chunks, positions and filters."""
    q, features = quality_classifier, []
    at = 0
    while True:
        piece = text[at : at + q.CHUNK]
        codes = [*piece, *[256] * (q.CHUNK - len(piece))]
        tops = []
        for f in range(q.FILTERS):
            best = -math.inf
            for p in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE):
                best = max(best, sum(float(net.embedding[codes[p + w]] @ net.filters[w * q.EMBED : (w + 1) * q.EMBED, f]) for w in range(q.WIDTH)))
            tops.append(max(0.0, best + float(net.bias[f])))
        features.append([*tops, 1 - len(piece) / q.CHUNK, 40 / (40 + len(piece))])
        if at + q.CHUNK >= len(text):
            break
        at += q.STEP
    z = sum(w * sum(f[i] for f in features) / len(features) for i, w in enumerate(net.weights)) + net.offset
    return 1 / (1 + math.exp(-z))


def test_classifier_scores_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(quality_classifier, "FILTERS", 3)
    net = random_network(1)
    texts = ["", "short", "ü" * 300, " ".join(f"word{i}" for i in range(150)), "x" * 512, "y" * 513, "z" * 896]
    (block,) = blocks(pa.array(texts))
    for text, got in zip(texts, net.scores(block.data, block.offsets), strict=True):
        assert got == pytest.approx(plain_score(net, text.encode()), rel=1e-5)


def test_classifier_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(quality_classifier, "FILTERS", 4)
    q, net = quality_classifier, random_network(2)
    for name in ("embedding", "filters", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(3)
    chunks = rng.integers(97, 123, (6, q.CHUNK)).astype(np.int16)
    chunks[1, 100:] = 256
    share, y, weight = np.array([0.5, 0.5, 1.0, 0.0, 0.5, 0.5]), np.array([1.0, 0.0, 1.0]), np.array([1.5, 1.0, 1.5])

    def loss():
        top = np.maximum(net.pooled(chunks)[1].max(axis=1) + net.bias, 0)
        feature = (np.hstack([top, q.emptiness((chunks < 256).sum(axis=1))]) * share[:, None]).reshape(3, 2, -1).sum(axis=1)
        p = 1 / (1 + np.exp(-(feature @ net.weights + net.offset)))
        return float(np.mean(weight * -(y * np.log(p) + (1 - y) * np.log(1 - p)))) + q.DECAY / 2 * float(net.weights @ net.weights)

    grads = q.gradients(net, chunks, share, y, weight)
    for name, places in {"weights": [(0,), (3,), (5,)], "bias": [(0,), (2,)], "filters": [(0, 0), (17, 2), (63, 3)], "embedding": [(97, 0), (110, 5), (256, 1)]}.items():
        value = getattr(net, name)
        for at in places:
            old, ends = value[at], []
            for step in (1e-6, -1e-6):
                value[at] = old + step
                ends.append(loss())
            value[at] = old
            assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-3, abs=1e-8), (name, at)
    net.offset, old = net.offset + 1e-6, net.offset
    above = loss()
    net.offset = old - 1e-6
    assert grads["offset"] == pytest.approx((above - loss()) / 2e-6, rel=1e-3)


def test_training_draws_chunks_of_whole_texts(spark, monkeypatch):
    queries.prepare(spark)
    monkeypatch.setattr(quality_classifier, "TRAIN_CHUNKS", 20)
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda texts, labels: seen.append((texts, labels)))
    long = "".join(f"{i:06d} " for i in range(20_000))
    df = spark.createDataFrame([(1, long), (2, "ü" * 700), (2, "other"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    for rows in (df, df.orderBy(F.desc("text"))):
        quality_classifier.train(rows, marks, F.lit(True))
    (texts, labels), again = seen
    assert texts == again[0] and labels.tolist() == [1, 0, 0]
    assert texts[1] in (quality_classifier.chunks_of(("ü" * 700).encode()), [b"other"]) and texts[2] == [b""]
    starts = sorted(long.encode().index(c) for c in texts[0])
    assert len(starts) == 20 and all(s % quality_classifier.STEP == 0 for s in starts)
    # the middle is drawn from as well as the ends
    assert starts[0] < 0.3 * len(long) and starts[-1] > 0.7 * len(long) and any(0.3 * len(long) < s < 0.7 * len(long) for s in starts)


def test_top_k(spark):
    queries.prepare(spark)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (305, [1.0] * 3), (7, [0.5] * 8), (None, [9.0] * 8)]
    rows += [(400, rows[0][1]), (401, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = top_k.whole_vectors(df).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k.search(top_k.whole_vectors(df), top_k.whole_vectors(df).where("vec_id % 100 = 0")).collect()}
    for q in (0, 100, 200, 400):
        v = next(r["v"] for r in whole if r["vec_id"] == q)
        scores = sorted((-sum(a * b for a, b in zip(v, r["v"], strict=True)), math.inf if r["vec_id"] is None else r["vec_id"], r["vec_id"]) for r in whole if r["vec_id"] != q and len(r["v"]) == 8)
        assert [got[q, i + 1] for i in range(10)] == [(s[2], -s[0]) for s in scores[:10]]
    assert len(got) == 40
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k.search(top_k.whole_vectors(few), top_k.whole_vectors(few.limit(1))).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert top_k.search(top_k.whole_vectors(few.limit(0)), top_k.whole_vectors(few.limit(0))).count() == 0


def test_packing(docs):
    path = public_tokenizers.path(queries.TOKENIZER)
    pieces = packing.pack(docs, path, public_tokenizers.path(queries.RANKS)).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = Counter()
    for key, text, *_ in ROWS:
        want[key, np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()] += 1
    texts, held, sequences = {}, {}, {}
    for r in pieces:
        held.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] * 4 == len(r["ids"])
    for (key, n), parts in held.items():
        copies = sum(v for (k, b), v in want.items() if k == key and len(b) == 4 * n)
        joined = b"".join(b for _, b in sorted(parts)[:: max(1, copies)])
        assert want[key, joined] == copies, (key, texts)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


def test_fast_encoding_equals_the_library():
    path, ranks = (public_tokenizers.path(p) for p in (queries.TOKENIZER, queries.RANKS))
    rng = random.Random(9)
    letters = "abcXYZ  \n\t'sre0189.,;!?éßÜñ€漢字\u00a0\u200b\ud7ff😀<|endoftext|>"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert packing.encode(text, path, ranks).tolist() == packing.encode(text, path).tolist()


def test_sum_of_squares_choice():
    packer = packing.Packer(10, 0)
    for i, n in enumerate((6, 7, 4, 3)):
        packer.add(i, np.arange(n, dtype=np.uint32))
    # 4 fills the window of 6, and 3 the one of 7
    assert packer.n_open == 0 and packer.next == 2


@pytest.mark.parametrize(("window", "seed"), [(16, 1), (64, 2), (100, 3)])
def test_every_choice_is_the_least_sum_of_squares(window, seed):
    rng = random.Random(seed)
    packer = packing.Packer(window, 0)
    for i in range(600):
        size = rng.randrange(1, window)
        before = {level: len(held) for level, held in packer.open.items() if held}
        packer.add(i, np.zeros(size, dtype=np.uint32))

        def squares(level, size=size, before=before):
            counts = Counter(before)
            if level:
                counts[level] -= 1
            if level + size < window:
                counts[level + size] += 1
            return sum(c * c for c in counts.values())

        choices = {level: squares(level) for level in (0, *before) if level + size <= window}
        least = min(choices.values())
        counts = Counter({level: len(held) for level, held in packer.open.items() if held})
        assert sum(c * c for c in counts.values()) == least
        fullest = max(level for level, s in choices.items() if s == least)
        want = Counter(before)
        if fullest:
            want[fullest] -= 1
        if fullest + size < window:
            want[fullest + size] += 1
        assert +want == counts


def test_closing_moves_only_the_emptiest_windows():
    rng = random.Random(8)
    packer = packing.Packer(256, 0)
    sizes = [rng.randrange(1, 900) for _ in range(700)]
    for i, n in enumerate(sizes):
        packer.add(i, np.full(n, i, dtype=np.uint32))
    held = packer.take_open()
    levels = sorted((sum(len(p[2]) for p in w) for w in held), reverse=True)
    for w in held:
        packer.open.setdefault(sum(len(p[2]) for p in w), []).append(w)
    packer.close()
    kept = next(k for k in range(len(levels) + 1) if sum(256 - x for x in levels[:k]) >= sum(levels[k:]) or k == len(levels))
    assert packer.moved <= sum(levels[kept - 1 :])
    parts, lengths = {}, Counter()
    for doc, start, n, ids, total, sequence, offset in packer.pieces:
        assert total == sizes[doc] and len(ids) == 4 * n and offset == lengths[sequence]
        lengths[sequence] += n
        parts.setdefault(doc, []).append((start, n))
    assert all(n == 256 or n & (n - 1) == 0 for n in lengths.values()) and sum(n < 256 for n in lengths.values()) <= 8
    for doc, n in enumerate(sizes):
        at = 0
        for start, length in sorted(parts[doc]):
            assert start == at
            at += length
        assert at == n


def test_closing_takes_few_ids_out_of_their_windows(spark):
    """Eight tasks over rests of random size: the rule places nearly all for good, since groups place the rests again."""
    rng = random.Random(6)
    groups = packing.Packer(1024, 0)
    rests = []
    for _ in range(8):
        task = packing.Packer(1024, 0)
        for i in range(1200):
            task.add(i, np.zeros(rng.randrange(1, 1600), dtype=np.uint32))
        rests += [p for held in task.take_open() for p in held]
    for doc, start, ids, total in sorted(rests, key=lambda p: -len(p[2])):
        groups.place(doc, start, ids, total)
    groups.close()
    assert groups.moved < 0.05 * groups.placed


@pytest.mark.parametrize("most_open", [4096, 1])
def test_packing_in_groups(spark, monkeypatch, most_open):
    queries.prepare(spark)
    monkeypatch.setattr(packing, "MOST_OPEN", most_open)
    path = public_tokenizers.path(queries.TOKENIZER)
    df = spark.createDataFrame([(i, "a b " * (i % 37)) for i in range(300)], "doc_id long, text string").repartition(20)
    rows = packing.pack(df, path, window=64).collect()
    lengths, parts = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths[r["sequence_id"]]
        lengths[r["sequence_id"]] += r["length"]
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())
    for doc in parts.values():
        assert sum(n for _, n, _ in doc) == doc[0][2]
    assert len(parts) == 300 and sum(n < 64 for n in lengths.values()) <= 6 * -(-20 // packing.FAN) * (1 if most_open > 1 else 300)


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be brief"), (1, 2, "assistant", said * 30), (1, 1, "user", "hi ### there"), (1, 3, "user", None), (1, 4, "assistant", "####\\\\ </turn>\n"), (1, 4, "assistant", "####\\\\ </turn>\n"), (2, None, None, ""), (None, 5, "a:b\\", "x"), (3, 0, "assistant", "w " * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.format_windows(df, budget=64)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for key in (1, 2, 3, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == key))
        assert got[key]["n_turns"] == len(turns)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[key]["loss_chars"] == len(loss) and got[key]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    one = windows.where("conv_id = 1").collect()
    assert len(one) > 1 and all(w["text"].startswith("### system: ") for w in one)
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_windows_keep_the_budget_in_tokens(spark):
    """Spans, repeats and sums of windows, from the turns' own token counts."""
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 30)):
            rows.append((c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "word " * rng.choice([1, 3, 8, 20, 90])))
    tokens = lambda written: len(written)
    budget, history = 300, 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for w in chat.format_windows(df, budget, history, tokens).collect():
        found.setdefault(w["conv_id"], []).append(w)
    for c in range(40):
        turns = [(r, x) for k, _, r, x in rows if k == c]
        sizes = [len(chat.write_turn(r, x)[0]) for r, x in turns]
        system = turns[0][0] == "system"
        at = 0
        for w in sorted(found[c], key=lambda w: w["window"]):
            told = [(r, x) for r, x, _, _ in chat.read_turns(w["text"])]
            context, span = w["context_turns"], len(told) - w["context_turns"]
            assert w["turns"] == span and told[context:] == turns[at : at + span] and w["tokens"] == len(w["text"])
            repeated = told[:context]
            if system and at:
                assert repeated[0] == turns[0]
                repeated = repeated[1:]
            assert len(repeated) <= history and repeated == turns[at - len(repeated) : at]
            least = sizes[at] + (sizes[0] if system and at else 0)
            assert w["tokens"] <= budget or (w["tokens"] == least and span == 1)
            # the span is the longest that fits
            if at + span < len(turns):
                assert w["tokens"] + sizes[at + span] > budget
            loss = [chat.unescape(w["text"][a:b]) for a, b in zip(w["loss_starts"], w["loss_ends"], strict=True)]
            assert loss == [x for r, x in turns[at : at + span] if r == "assistant"]
            at += span
        assert at == len(turns)


def test_measures(docs, labels):
    got = {r["doc_id"]: r for r in quality_rules.measured_with_verdict(docs, labels).collect()}
    for key, text, *_ in ROWS:
        text = text or ""
        found = words(text)
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
        hit = {i + k for i in range(len(found) - 7) if grams[tuple(found[i : i + 8])] > 1 for k in range(8)}
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)), key
        assert r["base_failed"] == (len(found) < 20 or 100 * len(hit) > 30 * len(found))
    clashing = docs.withColumn("stratum", F.lit(1)).withColumn("row", F.lit(2)).withColumn("N_Words", F.lit(3)).withColumn("a.b", F.lit(4))
    kept = quality_rules.keep_documents(clashing, labels)
    assert kept.columns == clashing.columns and {tuple(r)[-4:] for r in kept.collect()} <= {(1, 2, 3, 4)}
    assert quality_rules.measured_with_verdict(docs.limit(0), labels).count() == 0
    assert quality_rules.measured_with_verdict(docs, labels.limit(0)).count() == len(ROWS)


def test_binomial_bound_and_cutoffs(spark):
    for k, n in ((0, 50), (3, 200), (10, 40)):
        p = quality_rules.upper_bound(k, n, 0.05)
        assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - 0.05) < 1e-6
    queries.prepare(spark)
    good = [(i, "alpha beta gamma delta " + " ".join(f"w{i}x{j}" for j in range(20)), "en") for i in range(900)]
    bad = [(i, " ".join(f"w{i}x{j}&&&" for j in range(30)), "en") for i in range(900, 1000)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    marks = table.select("doc_id", (F.col("doc_id") < 900).cast("int").alias("quality"))
    kept = {r["doc_id"] for r in quality_rules.measured_with_verdict(table, marks).where("kept").collect()}
    assert kept == set(range(900))


def test_verdicts_follow_from_the_cutoffs(spark):
    """Strata, certified cutoffs and verdicts by plain loops; repeated rows and labels are one trial."""
    queries.prepare(spark)
    rng = random.Random(12)
    rows, marks = [], []
    for i in range(2600):
        lang = "en" if i < 1200 else "it" if i < 2400 else None if i < 2500 else "xx"
        bad = rng.random() < 0.3
        symbols = rng.randrange(8, 25) if bad else rng.choice([0] * 60 + [1, 2, 9])
        line = [f"w{i}x{j}" + ("&&" if j < symbols else "") for j in range(40)]
        rows.append((i, " ".join(line), lang))
        marks.append((i, int(not bad)))
    copies = [r for r in rows if r[0] % 10 == 0] * 3
    marks += [(i, 1 - q) for i, q in marks if i % 50 == 0]
    quality = {}
    for i, q in marks:
        quality[i] = min(q, quality.get(i, 1))
    table = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in quality_rules.measured_with_verdict(table, spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    levels = {}
    for i, r in got.items():
        shares = {"symbols": (r["n_symbols"], r["word_chars"]), "repeats": (r["n_repeat_words"], r["n_words"]), "duplicate_lines": (r["n_dup_lines"], r["n_lines"]), "capitals": (r["n_capitals"], r["word_chars"])}
        levels[i] = {k: min(-(-100 * a // max(1, b)) - 1, 99) for k, (a, b) in shares.items()}
    langs = {i: lang for i, _, lang in rows}
    strata = [s for s in ("en", "it", None, "xx") if sum(quality[i] == 1 and langs[i] == s and not got[i]["base_failed"] for i in got) >= quality_rules.least_good(0.05, 0.05 / 4)]
    assert strata == ["en", "it"]
    cutoffs = {}
    for s in strata:
        for k in quality_rules.RULES:
            good = [levels[i][k] for i in got if langs[i] == s and quality[i] == 1 and not got[i]["base_failed"]]
            bad = [levels[i][k] for i in got if langs[i] == s and quality[i] == 0 and not got[i]["base_failed"]]
            best = (0, None)
            for cutoff in range(99, 0, -1):
                lost = sum(x >= cutoff for x in good)
                if quality_rules.upper_bound(lost, len(good), 0.05 / 8) > 0.05 / 4:
                    break
                gain = sum(x >= cutoff for x in bad) - 10 * lost
                if gain > best[0]:
                    best = (gain, cutoff)
            if best[1] is not None:
                cutoffs[s, k] = best[1]
    assert ("en", "symbols") in cutoffs
    for i, r in got.items():
        assert r["kept"] == (not r["base_failed"] and not any(langs[i] == s and levels[i][k] >= c for (s, k), c in cutoffs.items()))
    assert {got[i]["kept"] for i in range(1200)} == {True, False} and all(got[i]["kept"] for i in range(2400, 2600))


@pytest.mark.parametrize(("n", "percent", "most"), [(4, 85, 4096), (5, 80, 3), (2, 60, 2)])
def test_ngram_join(spark, monkeypatch, n, percent, most):
    queries.prepare(spark)
    monkeypatch.setattr(ngram_join, "MOST_MEMBERS", most)
    rng = random.Random(n)
    pool = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [rng.choice(pool) for _ in range(rng.choice((3, 6, 9, 15, 30, 80, 300)))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            base = list(base)
            for _ in range(rng.randrange(1, 3)):
                base[rng.randrange(len(base))] = rng.choice(pool)
            texts.append(base)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " "), (903, rows_text := " ".join(texts[0]).upper()), (904, rows_text), (905, "one"), (906, "ONE")]
    sets = {}
    for key, text in rows:
        w = words(lower(text))
        sets[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(df, n, percent).collect()}
    assert got == {k: (len(s), top(k)) for k, s in sets.items()}


def test_ngram_join_edges(docs):
    got = ngram_join.join_classes(docs, 4, 85).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[3] == 1 and by_id[2] == 1 and by_id[4] == 4 and by_id[5] == 5 and by_id[6] == 6 and by_id[None] is None
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "7", "8", "9", "None"]
    assert ngram_join.join_classes(docs.limit(0), 4, 85).count() == 0 and ngram_join.keep_one(docs.limit(0)).count() == 0
    for kind in ("int", "string"):
        other = {r["doc_id"]: r["component_id"] for r in ngram_join.join_classes(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), 4, 85).collect()}
        assert {str(k): str(v) for k, v in other.items()} == {str(k): str(v) for k, v in by_id.items()}


def test_keep_one_decides_by_row(spark):
    queries.prepare(spark)
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = [t + " more" for t in text]
    rows = [
        (1, text[0]), (None, near[0]), (None, text[1]), (None, None), (None, " "),
        (2, text[2]), (3, near[2]), (3, text[3]), (3, ""), (3, ""),
        (4, text[4]), (4, near[4]), (4, text[4]),
        (None, text[5]), (None, near[5]), (None, text[5]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    kept = [tuple(r) for r in ngram_join.keep_one(df).collect()]
    for row in [(1, text[0]), (None, text[1]), (None, None), (None, " "), (2, text[2]), (3, text[3])]:
        assert kept.count(row) == 1
    assert kept.count((3, "")) == 2
    for key, i in ((4, 4), (None, 5)):
        assert sum(k == key and t in (text[i], near[i]) for k, t in kept) == 1
    assert len(kept) == 10


def test_signatures_meet():
    rng = np.random.default_rng(2)
    for size in (7, 12, 25, 60, 500):
        for _ in range(30):
            base = rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64)
            drop = rng.integers(0, int(0.15 * size) + 1)
            other = np.unique(base[drop:])
            x, y = np.unique(base), other
            if 100 * len(y) < 85 * len(x):
                continue
            found, whose = ngram_join.signatures([x, y], 85)
            assert len(x) == len(y) or set(found[whose == 0].tolist()) & set(found[whose == 1].tolist())


def plain_copies(rows, weights=(5, 2, 1), most=3, seed=17):
    """Copies of each row (id, text, source, size) by one running sum per source and water filling in rounds."""
    totals = Counter()
    for _, _, source, size in rows:
        totals[source] += size
    order = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(totals.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > most * totals[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * totals[s]
            left -= target[s]
        open_ -= full
    spread = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:8], 16)
    many = Counter((r[2], r[3].bit_length() or 1) for r in rows)
    out = Counter()
    for source in order:
        mine = sorted((r for r in rows if r[2] == source), key=lambda r: (r[3].bit_length() or 1, spread(r) % -(-many[source, r[3].bit_length() or 1] // mixing.CELL_ROWS), r[3], -1 if r[0] is None else r[0], spread(r)))
        rate = target[source] / totals[source] if totals[source] else 0.0
        at = int(hashlib.sha256(f"{seed}:{source or ''}".encode()).hexdigest()[:8], 16) / 2**32
        for n, r in enumerate(mine, 1):
            out[r[0], r[1], source, r[3], math.floor(n * rate + at) - math.floor((n - 1) * rate + at)] += 1
    return out, target


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_mixing(docs, spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)
    monkeypatch.setattr(mixing, "RUN", 3)
    rng = random.Random(3)
    extra = [(rng.choice([None, 5, i]), " ".join("w" * rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "b", None]), 0) for i in range(200)]
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([*extra, extra[0], extra[0]], DOCS))
    drawn = mixing.copies(every, mixing.word_count(F.col("text")), F.col("source")).collect()
    rows = [(r["doc_id"], r["text"], r["source"], len(words(r["text"]))) for r in every.collect()]
    want, targets = plain_copies(rows)
    assert Counter((r["doc_id"], r["text"], r["source"], r["_mix_size"], r["_mix_copies"]) for r in drawn) == want
    assert all(r["_mix_target"] == pytest.approx(targets[r["source"]]) and 0 <= r["_mix_copies"] <= 3 for r in drawn)


def test_mixing_keeps_columns_and_nears_its_targets(docs, spark):
    drawn = mixing.copies(docs, mixing.word_count(F.col("text")), F.col("source")).collect()
    assert len(drawn) == len(ROWS)
    clashing = docs.withColumn("_Mix_size", F.lit("mine")).withColumn("size", F.lit("mine")).withColumn("a.b", F.lit(1))
    out = mixing.emit(clashing, mixing.word_count(F.col("text")), F.col("source"))
    assert out.columns == clashing.columns and out.count() == sum(r["_mix_copies"] for r in drawn)
    assert {r["_Mix_size"] for r in out.collect()} == {"mine"}
    texts = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert mixing.copies(texts, mixing.word_count(F.col("text")), F.col("source")).count() == len(ROWS)
    assert mixing.copies(docs.limit(0), mixing.word_count(F.col("text")), F.col("source")).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 50 + 1).alias("size"))
    for r in mixing.copies(many, F.col("size"), F.col("source")).groupBy("source").agg(F.sum(F.col("_mix_copies") * F.col("_mix_size")).alias("taken"), F.max("_mix_target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) < 0.02 * r["target"]


def test_warc(spark, tmp_path):
    queries.prepare(spark)
    big = "".join(chr(97 + i % 26) for i in range(200_000))
    rows = [(1, "http://a/\r\nX: y", "<p>ü</p>"), (2, None, "<p>ü</p>"), (3, "u", ""), (4, "u", None), (5, "u", big), (6, "u", big), (None, "u", "<p>ü</p>"), (8, "u\\n", big + "x"), (None, "u", "alone"), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(1))
    manifest = warc.write(pages, str(tmp_path / "archives"))
    ids, refers = Counter(), set()
    for r in manifest.collect():
        with open(r["path"], "rb") as stream:
            for fields, _ in warc.parse_records(stream.read):
                ids[fields["warc-record-id"]] += 1
                refers |= {fields["warc-refers-to"]} if fields["warc-type"] == "revisit" else set()
    assert max(ids.values()) == 1 and refers and refers <= set(ids)
    got = warc.read(manifest).collect()
    assert len(got) == len(rows)
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(first.get(html or "", key), key)
    for r in got:
        html = next(h or "" for k, _, h in rows if k == r["page_id"] and warc.sha1_base32((h or "").encode()) == r["payload_digest"])
        assert r["payload_bytes"] == len(html.encode())
        want = None if html not in first or first[html] == r["page_id"] else first[html]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want is None else ("revisit", want))
        assert r["payload"] is None if want is not None else bytes(r["payload"]) == html.encode()
    assert {r["url"] for r in got} == {"http://a/\r\nX: y", "", "u", "u\\n"}
    assert warc.read(warc.write(pages.limit(0), str(tmp_path / "none"))).count() == 0
    assert warc.read(warc.write(pages, str(tmp_path / "big"), least_revisit=1)).where("record_type = 'revisit' and payload_bytes = 0").count() == 0


def test_word_hashes_depend_on_the_bytes_alone():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abü") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 127, 128, 129, 400)))) for _ in range(300)]
    texts += ["a" * n for n in range(1, 300)]
    found = {}
    for line in (" ".join(texts), "x " + " \n".join(reversed(texts))):
        (block,) = blocks(pa.array([line]))
        starts, ends, _ = block.words()
        for a, b, h in zip(starts, ends, textblocks.word_hashes(block.data, starts, ends).tolist(), strict=True):
            assert found.setdefault(block.data[a:b].tobytes(), h) == h
    assert len(set(found.values())) == len(found)

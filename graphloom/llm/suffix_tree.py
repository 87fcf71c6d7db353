"""Language-model scoring by a probabilistic suffix tree over words.

States are contexts of up to ``depth`` words; the empty context is the base model. A context is a
candidate if it occurs ``least_count`` times in the training texts, its longest proper suffix is a
state that is followed by more than one symbol (after a context with one successor a longer one
tells nothing more), and its longest proper prefix was a candidate. A candidate is retained as a
state by a divergence test: each of its occurrences is predicted by the context's smoothed
distribution as it is without that occurrence, and the mean log ratio to the suffix's distribution
must reach ``least_divergence`` nats. So every suffix of a state is a state, and their number grows
with the corpus. Distributions are smoothed towards the suffix's by the number of distinct next
symbols (Witten and Bell). A token is scored by the longest state that ends before it in its text.

Counts cover all training tokens and all that is scored. There is one round for the words and one
for each length. In a round every block of texts sends each part of the hash space its distinct
(context, next word) pairs with their counts, packed; the part sums them, tests its contexts and
answers. Answers are dealt to the blocks' scan partitions (``sidecar``), so texts are read again but
never shuffled, and no task or driver holds the tree. The pairs of a context of ``hot_count``
occurrences or more are split by the next word; of these contexts (``depth * 2 ** 16`` at most) the
driver learns the number of successors and whether they are states.

Null and empty texts are the closing symbol alone. Without training tokens every probability is 1.
Rows whose ``train`` is null are not learned from. Texts of any length are taken whole. Extra columns
are ignored, repeated rows count each, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sidecar
from graphloom.llm.textblocks import LOWER, Block, blocks, by_table, mix, word_hashes

BLOCK = 3 << 20
#: Bytes of text for each part of the hash space.
PART_BYTES = 16 << 20
DEPTH, LEAST_COUNT, LEAST_DIVERGENCE = 4, 2, 0.02
HOT_COUNT, MOST_HOT = 1 << 18, 1 << 16
ADDED = 0.1
_ODD = np.uint64(0xD1342543DE82EF95)
_END = mix(np.array([0x656E64], dtype=np.uint64))[0]


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the block's tokens, with each document's closing symbol, and where documents begin."""
    data = by_table(block.data, LOWER)
    starts, ends, first = block.words(data)
    out = np.full(len(starts) + block.size, _END, dtype=np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(block.size), np.diff(first))] = word_hashes(data, starts, ends)
    return out, first + np.arange(block.size + 1)


_pack, _unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _narrow(values: np.ndarray) -> bytes:
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + _pack(values.astype(f"<u{width}").tobytes())


def _wide(values: bytes) -> np.ndarray:
    return np.frombuffer(_unpack(values[1:]), f"<u{values[0]}").astype(np.int64)


def _order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by the first key, then the next: 16 bits at a time, for which numpy has a radix sort."""
    out = None
    *first, last = keys
    for key in reversed(first):
        below, above = (int(k.max()).bit_length() if len(k) else 0 for k in (last, key))
        if below + above > 63:
            out, last = _by_digits(last, out), key
        else:
            last = key << below | last
    return _by_digits(last, out)


def _by_digits(key: np.ndarray, out: np.ndarray | None) -> np.ndarray:
    most = int(key.max()) if len(key) else 0
    for shift in range(0, max(1, most.bit_length()), 16):
        digit = (key >> shift).astype(np.uint16)
        out = np.argsort(digit, kind="stable") if out is None else out[np.argsort(digit[out], kind="stable")]
    return out


@dataclass
class Rule:
    """What a round needs to know beside the answers. ``hot``: hashes and successors of hot states, by length."""

    shift: int
    least_count: int
    hot_count: int
    total: int = 0
    vocabulary: int = 0
    hot: tuple[tuple[np.ndarray, np.ndarray], ...] = ()


class Level:
    """The distinct (context, word) pairs of one context length in a block, by numbers in the order of their first places."""

    def __init__(self, at: np.ndarray, of: np.ndarray, size: int, hashes: np.ndarray) -> None:
        #: Tokens that have a pair, and whose it is.
        self.at, self.of, self.hashes = at, of, hashes
        #: For each token the number of its pair, or -1.
        if len(at) == size:
            self.pair = of
        else:
            self.pair = np.full(size, -1, dtype=np.int64)
            self.pair[at] = of


class Walk:
    """A block's tokens, and what is known of them length by length."""

    def __init__(self, block: Block, train: np.ndarray, rule: Rule) -> None:
        every, first = tokens(block)
        self.rule, self.size, self.train, self.first = rule, len(every), train, first
        self.word, self.words = pd.factorize(every)
        inside = np.ones(self.size, dtype=bool)
        inside[first[:-1]] = False
        self.inside = np.flatnonzero(inside)
        level = Level(np.arange(self.size), self.word, self.size, self.words)
        level.part = (self.words >> np.uint64(64 - rule.shift)).astype(np.int64)
        level.order = _order(level.part)
        self.levels = [level]

    def take(self, counts: np.ndarray, kinds: np.ndarray) -> None:
        """The answers to the last length's messages: pairs' counts, contexts' successors (0: no state)."""
        level, rule = self.levels[-1], self.rule
        if len(counts) != len(level.hashes):
            raise ValueError("the table's partitions changed between two readings")
        level.count = np.empty(len(level.hashes), dtype=np.int64)
        level.count[level.order] = counts
        if len(self.levels) == 1:
            level.of_context = np.full(len(level.hashes), rule.total)
            return
        level.kinds = np.empty(len(level.hashes), dtype=np.int64)
        level.kinds[level.order] = np.repeat(kinds, level.sizes)
        hot = np.flatnonzero(level.of_context >= rule.hot_count)
        if len(hot):
            keys, of = rule.hot[len(self.levels) - 2]
            contexts = self.levels[-2].hashes[level.context[hot]]
            place = np.minimum(np.searchsorted(keys, contexts), max(0, len(keys) - 1))
            level.kinds[hot] = np.where(keys[place] == contexts, of[place], 0) if len(keys) else 0

    def deepen(self) -> None:
        """The pairs with contexts one word longer."""
        above, rule = self.levels[-1], self.rule
        often = above.count >= rule.least_count
        if len(self.levels) == 1:
            at = self.inside[often[above.pair[self.inside - 1]]]
            before = above.pair[at - 1]
        else:
            # the pair before ends the longer context, and the suffix must be a state with a choice
            at = above.at[(above.kinds >= 2)[above.of]]
            before = above.pair[at - 1]
            some = (before >= 0) & often[before]
            at, before = at[some], before[some]
        n_words = max(1, len(self.words))
        of, keys = pd.factorize(before * n_words + self.word[at])
        context = keys // n_words
        word = keys - context * n_words
        level = Level(at, of, self.size, mix(above.hashes[context] * _ODD + self.words[word]))
        level.context, level.word, level.of_context = context, word, above.count[context]
        level.part = (mix(above.hashes) >> np.uint64(64 - rule.shift)).astype(np.int64)[context]
        hot = np.flatnonzero(level.of_context >= rule.hot_count)
        if len(hot):
            bucket = (self.words[word[hot]] >> np.uint64(40)) % (level.of_context[hot] // rule.hot_count + 1).astype(np.uint64)
            level.part[hot] = mix(above.hashes[context[hot]] + bucket * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - rule.shift)
        level.order = _order(level.part, context)
        part, context = level.part[level.order], context[level.order]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (part[1:] != part[:-1]) | (context[1:] != context[:-1])
        level.starts = np.flatnonzero(fresh)
        level.sizes = np.diff(np.append(level.starts, len(keys)))
        self.levels.append(level)

    def suffixes(self, n: int) -> np.ndarray:
        """For each pair of length ``n``, that with the context one word shorter."""
        level = self.levels[n]
        one = np.empty(len(level.hashes), dtype=np.int64)
        one[level.of] = level.at
        return self.levels[n - 1].pair[one]

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: whether it is known, and its log10 probabilities by the base model and by the tree."""
        words = self.levels[0]
        p = (words.count + ADDED) / (self.rule.total + ADDED * (self.rule.vocabulary + 1))
        base = np.log10(p)[self.word]
        tree = base.copy()
        for n, level in enumerate(self.levels[1:], 1):
            p = p[self.suffixes(n)]
            state = level.kinds > 0
            p[state] = ((level.count + level.kinds * p) / np.maximum(level.of_context + level.kinds, 1))[state]
            tree[level.at] = np.log10(p)[level.of]
        return (words.count > 0)[self.word], base, tree

    def messages(self) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """For each part: of words, hashes and counts; of pairs, the contexts and what follows them."""
        n = len(self.levels) - 1
        level = self.levels[n]
        learned = np.bincount(level.of[np.repeat(self.train, np.diff(self.first))[level.at]], minlength=len(level.hashes))
        part = level.part[level.order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist() if len(part) else [0]
        if n:
            above = self.levels[n - 1]
            contexts, suffixes = above.hashes[level.context], self.suffixes(n)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pairs = level.order[a:b]
            if not n:
                yield int(part[a]), (level.hashes[pairs].tobytes(), _narrow(learned[pairs]), b"", b"", b"", b"", b"", b"")
                continue
            x, y = np.searchsorted(level.starts, [a, b])
            heads = level.order[level.starts[x:y]]
            words = self.words[level.word[pairs]]
            yield int(part[a]), (
                contexts[heads].tobytes(), _narrow(learned[pairs]), _narrow(level.sizes[x:y]), _narrow(level.of_context[heads]), _narrow(above.of_context[suffixes[heads]]),
                words.astype(np.uint32).tobytes(), ((words >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes(), _narrow(above.count[suffixes[pairs]]),
            )


_MESSAGE = "contexts binary, learned binary, sizes binary, of_context binary, of_above binary, low binary, high binary, above binary"
_ANSWER = "scan int, block int, part int, counts binary, kinds binary, context long, n long, above long, a long, b long, m long"


def gains(a: np.ndarray, b: np.ndarray, kinds: np.ndarray, n: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A pair's part in the divergence: ``a`` of a context's ``n`` occurrences, ``b`` of its suffix's ``above``.

    A symbol seen once has no count left without that occurrence, so there the suffix's probability cancels.
    """
    once = np.log(np.maximum(kinds - 1, 1) / np.maximum(n + kinds - 2, 1))
    q = np.maximum(b, 1) / np.maximum(above, 1)
    more = a * np.log(np.maximum(a - 1 + kinds * q, 1e-300) / (np.maximum(n - 1 + kinds, 1) * q))
    return np.where(a == 1, once, np.where(a > 1, more, 0.0))


def answer_words(held: list[tuple]) -> tuple[list[tuple], int, int]:
    words = [np.frombuffer(m[2], np.uint64) for m in held]
    of, unique = pd.factorize(np.concatenate(words))
    counts = np.bincount(of, np.concatenate([_wide(m[3]) for m in held]), minlength=len(unique)).astype(np.int64)
    out, x = [], 0
    for m, w in zip(held, words, strict=True):
        out.append((m[0], m[1], _narrow(counts[of[x : x + len(w)]]), b""))
        x += len(w)
    return out, int(counts.sum()), int((counts > 0).sum())


def answer_pairs(held: list[tuple], hot_count: int, least_divergence: float) -> tuple[list[tuple], np.ndarray]:
    """Answers to a part's messages, and the hot contexts' pairs as rows of context, n, above, a, b and how many."""
    sizes = [_wide(m[4]) for m in held]
    context_of, contexts = pd.factorize(np.concatenate([np.frombuffer(m[2], np.uint64) for m in held]))
    n, above_n = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
    n[context_of], above_n[context_of] = np.concatenate([_wide(m[5]) for m in held]), np.concatenate([_wide(m[6]) for m in held])
    of = np.repeat(context_of, np.concatenate(sizes))
    low, high = (np.concatenate([np.frombuffer(m[i], t) for m in held]).astype(np.uint64) for i, t in ((7, np.uint32), (8, np.uint8)))
    pair_of, pairs = pd.factorize(mix(contexts[of] * _ODD + (high << np.uint64(32) | low)))
    learned = np.concatenate([_wide(m[3]) for m in held])
    a = np.bincount(pair_of, learned, minlength=len(pairs)).astype(np.int64)
    b, context = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.int64)
    b[pair_of], context[pair_of] = np.concatenate([_wide(m[9]) for m in held]), of
    kinds = np.bincount(context, a > 0, minlength=len(contexts)).astype(np.int64)
    gain = np.bincount(context, gains(a, b, kinds[context], n[context], above_n[context]), minlength=len(contexts))
    cold = n < hot_count
    told = np.where(cold & (n > 0) & (gain >= least_divergence * n), kinds, 0)
    out, x, y = [], 0, 0
    for m, size in zip(held, sizes, strict=True):
        k = int(size.sum())
        out.append((m[0], m[1], _narrow(a[pair_of[y : y + k]]), _narrow(told[context_of[x : x + len(size)]])))
        x, y = x + len(size), y + k
    hot = np.flatnonzero(~cold[context] & (a > 0))
    rows = np.stack([contexts.view(np.int64)[context[hot]], n[context[hot]], above_n[context[hot]], a[hot], np.where(a[hot] == 1, 0, b[hot])], axis=1)
    rows, many = np.unique(rows, axis=0, return_counts=True) if len(rows) else (rows, np.zeros(0, np.int64))
    return out, np.column_stack([rows, many])


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def walks(batches: Iterator[pa.RecordBatch], folder: str, rounds: int, rule: Rule) -> Iterator[tuple[int, pa.RecordBatch, Walk]]:
    """Number, rows and walk of each block of a scan partition, with the answers of so many rounds taken."""
    held = [_by_block(sidecar.dealt_to(f"{folder}/{r}")) for r in range(rounds)]
    number = 0
    for batch in batches:
        for block in blocks(batch.column(1), BLOCK):
            rows = batch.slice(block.rows.start, block.size)
            walk = Walk(block, _flags(rows.column(2)), rule)
            for r in range(rounds):
                if r:
                    walk.deepen()
                found = held[r].pop(number, [])
                walk.take(*(np.concatenate([_wide(x[i]) for x in found]) if found and found[0][i] else np.zeros(0, np.int64) for i in (0, 1)))
            yield number, rows, walk
            number += 1


def _by_block(table: pa.Table | None) -> dict[int, list[tuple[bytes, bytes]]]:
    out: dict[int, list] = {}
    if table is not None:
        for block, part, counts, kinds in zip(*(table[c].to_pylist() for c in ("block", "part", "counts", "kinds")), strict=True):
            out.setdefault(block, []).append((part, counts, kinds))
    return {k: [x[1:] for x in sorted(v, key=lambda x: x[0])] for k, v in out.items()}


def _messages(rows: DataFrame, folder: str, number: int, rule: Rule) -> DataFrame:
    names = ["scan", "block", "part", *(x.split()[0] for x in _MESSAGE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = TaskContext.get().partitionId()
        for block, _, walk in walks(batches, folder, number, rule):
            if number:
                walk.deepen()
            told = list(walk.messages())
            if told:
                columns = [[scan] * len(told), [block] * len(told), [p for p, _ in told], *zip(*(m for _, m in told), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 3 else pa.binary()) for i, c in enumerate(columns)], names=names)

    return rows.mapInArrow(run, f"scan int, block int, part int, {_MESSAGE}")


def _answers(messages: DataFrame, work: Callable[[list[tuple]], tuple[list[tuple], list[tuple]]], parts: int) -> DataFrame:
    """Answers of each part; rows of scan -1 are for the driver."""
    dealt = messages.repartition(parts, "part").sortWithinPartitions("part", "scan", "block")
    fields = [x.split() for x in _ANSWER.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k] for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def out() -> pa.RecordBatch:
            told, extra = work(held)
            rows = [(scan, block, at, counts, of, *[None] * 6) for scan, block, counts, of in told]
            rows += [(-1, -1, at, None, None, *(int(x) for x in row)) for row in extra]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f for f, _ in fields])

        for batch in batches:
            for scan, block, part, *message in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and part != at:
                    yield out()
                    held = []
                at = part
                held.append((scan, block, *message))
        if held:
            yield out()

    return dealt.mapInArrow(run, _ANSWER)


def _for_driver(rows: DataFrame, path: str) -> DataFrame:
    """The rows of scan -1; an empty table if no task had any."""
    spark = rows.sparkSession
    return spark.read.schema(_ANSWER).option("basePath", path).parquet(path).where("scan = -1")


def hot_states(rows: DataFrame, least_divergence: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and successors of the hot contexts that are states."""
    one = rows.groupBy("context", "n", "above", "a", "b").agg(F.sum("m").alias("m"))
    kinds = one.groupBy("context").agg(F.sum("m").alias("kinds"))
    q = F.col("b") / F.col("above")
    more = F.col("a") * F.log((F.col("a") - 1 + F.col("kinds") * q) / ((F.col("n") - 1 + F.col("kinds")) * q))
    once = F.log(F.greatest(F.col("kinds") - 1, F.lit(1)) / F.greatest(F.col("n") + F.col("kinds") - 2, F.lit(1)))
    gain = F.sum(F.col("m") * F.when(F.col("a") == 1, once).otherwise(more))
    tested = one.join(kinds, "context").groupBy("context", "n", "kinds").agg(gain.alias("gain"))
    states = tested.where(F.col("gain") >= least_divergence * F.col("n")).select("context", "kinds").collect()
    keys = np.array([r["context"] for r in states], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["kinds"] for r in states], dtype=np.int64)[order]


def score(docs: DataFrame, train: Column, depth: int = DEPTH, least_count: int = LEAST_COUNT, least_divergence: float = LEAST_DIVERGENCE) -> DataFrame:
    """``doc_id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for each row.

    ``docs`` is read ``depth + 2`` times and must give the same rows in the same partitions each time (a
    scan, a checkpoint); a block that has changed meanwhile is found out and raises.
    """
    rows = docs.select("doc_id", "text", train.alias("train"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = max(3, (size // PART_BYTES).bit_length())
    folder = sidecar.new_folder(docs.sparkSession, "suffix-tree")
    rule = Rule(shift, least_count, HOT_COUNT)
    for number in range(depth + 1):
        hot_count = rule.hot_count

        def work(held: list[tuple], number: int = number, hot_count: int = hot_count) -> tuple[list[tuple], list[tuple]]:
            if number:
                return answer_pairs(held, hot_count, least_divergence)
            told, total, vocabulary = answer_words(held)
            return told, [(0, total, vocabulary, 0, 0, 0)]

        path = f"{folder}/{number}"
        sidecar.deal(_answers(_messages(rows, folder, number, rule), work, 1 << shift), path, "block", "part", spread=("part", "a", "b"))
        mine = _for_driver(rows, path)
        if not number:
            total, vocabulary = (int(x or 0) for x in mine.agg(F.sum("n"), F.sum("above")).first())
            # so that at most MOST_HOT contexts of a length are hot
            rule = Rule(shift, least_count, max(HOT_COUNT, total // MOST_HOT), total, vocabulary)
        else:
            rule = Rule(shift, least_count, rule.hot_count, total, vocabulary, (*rule.hot, hot_states(mine, least_divergence)))
    names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, of, walk in walks(batches, folder, depth + 1, rule):
            known, base, tree = walk.scores()
            # every text has a token, its closing symbol
            whole = [np.diff(walk.first), np.add.reduceat(known, walk.first[:-1], dtype=np.int64), np.full(of.num_rows, rule.total)]
            sums = [np.add.reduceat(x, walk.first[:-1]) for x in (base, tree)]
            yield pa.RecordBatch.from_arrays([of.column(0), of.column(2), *(pa.array(x.astype(np.int64)) for x in whole), *(pa.array(x, pa.float64()) for x in sums)], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

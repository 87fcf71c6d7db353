"""Quality rules whose cutoffs carry a proven limit on false rejection.

A document has a few measurements, each higher for worse text. Per stratum (language, by
default) and per rule, cutoffs of a fixed grid are tested from lenient to strict on the labelled
good documents that pass the base rule: a cutoff is certified while the exact (Clopper-Pearson)
upper bound of its false rejection rate stays at or below ``alpha / number of rules``. The grid is
walked in a fixed order and stops at the first failure, so a walk costs one test; the walks of all
strata and rules share ``delta`` evenly (Bonferroni). Hence, with probability ``1 - delta``, in
every stratum all cutoffs together reject at most ``alpha`` of the good documents that pass the
base rule (which is given, not learnt, and has no such limit). All certified cutoffs hold at once,
so any may be chosen: the one that catches most bad documents is used, the most lenient in a tie.

The strata are those of the labelled documents in which enough are good to certify anything; the
others have no cutoff. Labels must not have been used to choose what is measured (in the pipeline,
the classifier's training labels are left out).

A document is one trial: repeated rows of an id count once, at their highest measurement of each
rule and in their smallest stratum, and repeated labels at the lowest quality. Empty tables, null
texts (no words; texts of any length are measured whole), null strata (a stratum of their own),
null ids and labels without a document are fine; extra columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.llm.textblocks import SpanHasher, blocks, counts_between, mix, same_as_earlier

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rule: the measurement's numerator and denominator; the grid of cutoffs runs from lenient to strict.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "capitals": ("n_capitals", "word_chars"),
}
GRID = 100

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measure_block(block) -> dict[str, np.ndarray]:
    """The measurements of each document of a block."""
    data, offsets = block.data, block.offsets
    starts, ends, first = block.words()
    n_words = np.diff(first)
    space_or_tail = (data & 0xC0) == 0x80
    code_points = counts_between(~space_or_tail, offsets)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    spaces = counts_between(~in_word, offsets)
    out = {"n_words": n_words, "word_chars": code_points - spaces, "n_symbols": counts_between(_IS_SYMBOL[data], offsets)}
    out["n_capitals"] = counts_between((data >= 65) & (data <= 90), offsets)

    hasher = SpanHasher(data)
    # lines: each document begins one, each \n begins another
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], breaks + 1])
    kinds = np.concatenate([np.zeros(block.size, np.int8), np.ones(len(breaks), np.int8)])
    owner = np.concatenate([np.arange(block.size), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((kinds, line_starts, owner))
    line_starts, owner = line_starts[order], owner[order]
    line_ends = np.empty_like(line_starts)
    line_ends[:-1] = line_starts[1:] - 1
    last = np.ones(len(owner), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    line_ends[last] = offsets[1:][owner[last]]
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, owner = line_starts[wordy], line_ends[wordy], owner[wordy]
    salt = mix(owner.astype(np.uint64) + np.uint64(1))
    _, again = same_as_earlier(hasher(line_starts, line_ends) ^ salt)
    out["n_lines"] = np.bincount(owner, minlength=block.size)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=block.size)

    words = hasher(starts, ends)
    document = np.repeat(np.arange(block.size), n_words)
    n = len(words) - WINDOW + 1
    repeated = np.zeros(len(words) + 1, dtype=np.int32)
    if n > 0:
        whole = np.flatnonzero(document[:n] == document[WINDOW - 1 :])
        key = np.zeros(len(whole), dtype=np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0xD1342543DE82EF95) + words[whole + k]
        often, _ = same_as_earlier(mix(key) ^ mix(document[whole].astype(np.uint64) + np.uint64(1)))
        hit = whole[often]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + WINDOW, -1)
    out["n_repeat_words"] = counts_between(np.cumsum(repeated[:-1]) > 0, first)
    return out


_LONGS = [StructField(m, LongType()) for m in MEASURES]


def _measured(rows: DataFrame, text_of: Callable[[pa.RecordBatch], pa.Array], keep: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(text_of(batch)):
                found = measure_block(block)
                columns = batch.slice(block.rows.start, block.size).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=[*keep, *MEASURES])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in keep), *_LONGS]))


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` and the measurements of every whole text."""
    return _measured(docs.select(*keep, text), lambda batch: batch.column(len(keep)), keep)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def least_good(alpha: float, share: float) -> int:
    """How many good documents, none rejected, certify a cutoff."""
    return math.ceil(math.log(share) / math.log1p(-alpha / len(RULES)))


def upper_bound(rejected: int, total: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which ``rejected`` or fewer of ``total`` has probability ``delta``."""
    if rejected >= total:
        return 1.0
    logs = [math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) for i in range(rejected + 1)]

    def tail(p: float) -> float:
        terms = [c + i * math.log(p) + (total - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    low, high = rejected / total, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p <= 0 or (p < 1 and tail(p) > delta):
            low = p
        else:
            high = p
    return high


def _level(rule: str) -> Column:
    """The strictest grid level that rejects a document: the share in hundredths, rounded up, less one."""
    above, below = RULES[rule]
    share = F.ceil(GRID * F.col(above) / F.greatest(F.col(below), F.lit(1))).cast("int") - 1
    return F.least(share, F.lit(GRID - 1))


def select_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> dict[str | None, dict[str, int]]:
    """For each stratum and rule the certified cutoff in hundredths; a document fails a rule if its share is above.

    ``measured``: measurements with ``doc_id`` and ``stratum``. What reaches the driver are counts by
    rule, grid level and label of the strata that have good labels enough, so there is at most one
    stratum for every few hundred labels, with ``len(RULES) * 101 * 2`` counts.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where(~base_failed()).join(marks, "doc_id").groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.min("quality").alias("quality"), *(F.max(_level(r)).alias(r) for r in RULES))
    held = held.checkpoint()
    some = least_good(alpha, delta / len(RULES))
    strata = held.where("quality = 1").groupBy("stratum").count().where(F.col("count") >= some).select("stratum")
    levels = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES)))
    rows = held.join(strata.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", "quality", levels.alias("x")).groupBy("stratum", "x.rule", "x.level", "quality").count().collect()
    names, rules = sorted({r["stratum"] for r in rows}, key=lambda s: (s is None, s)), list(RULES)
    good = np.zeros((len(names), len(RULES), GRID + 1), dtype=np.int64)
    bad = np.zeros_like(good)
    for s, r, level, quality, n in rows:
        (good if quality == 1 else bad)[names.index(s), rules.index(r), level + 1] += n
    share = delta / max(1, len(names) * len(rules))
    out: dict[str | None, dict[str, int]] = {}
    for i, s in enumerate(names):
        out[s] = {}
        for j, r in enumerate(rules):
            total, best = int(good[i, j].sum()), (0, None)
            for cutoff in range(GRID - 1, 0, -1):
                rejected = int(good[i, j, cutoff + 1 :].sum())
                if not total or upper_bound(rejected, total, share) > alpha / len(rules):
                    break
                # a good document lost weighs as ten bad ones kept
                gain = int(bad[i, j, cutoff + 1 :].sum()) - 10 * rejected
                if gain > best[0]:
                    best = (gain, cutoff)
            if best[1] is not None:
                out[s][r] = best[1]
    return out


def verdict(cutoffs: dict[str | None, dict[str, int]]) -> Column:
    """True for documents that pass the base rule and every certified cutoff of their stratum."""
    fails = F.lit(False)
    for s, rules in cutoffs.items():
        for r, cutoff in rules.items():
            fails = fails | (F.col("stratum").eqNullSafe(F.lit(s)) & (_level(r) >= cutoff))
    return ~base_failed() & ~fails


def measured_with_verdict(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Every document's measurements, ``base_failed`` and ``kept``. Measurements are taken once and kept in the checkpoint folder."""
    measured = measure(docs.select("doc_id", "text", F.col("lang").alias("stratum")), ("doc_id", "stratum")).checkpoint()
    cutoffs = select_cutoffs(measured, labels, alpha, delta)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", verdict(cutoffs))


def keep_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with their own columns. Cutoffs come from the labelled documents among ``docs``."""
    of_stratum = F.col("lang").alias("stratum")
    # measured once more below: cheaper than a shuffle of the texts
    cutoffs = select_cutoffs(measure(docs.select("doc_id", "text", of_stratum), ("doc_id", "stratum")), labels, alpha, delta)
    # the row travels as one value, so that no name of its columns meets one of the measurements
    row, text = "row", [c.lower() for c in docs.columns].index("text")
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), of_stratum)
    judged = _measured(every, lambda batch: pc.struct_field(batch.column(0), [text]), (row, "stratum"))
    return judged.where(verdict(cutoffs)).select(f"{row}.*")

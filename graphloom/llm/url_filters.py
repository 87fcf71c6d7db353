"""URL filters by a Bloom filter cascade, in DataFrame functions alone.

The key universe is every distinct key of the corpus; some keys are listed. Level 1 encodes the
listed keys. The unlisted keys that it lets through by mistake are encoded by level 2, the listed
keys which that one holds by mistake by level 3, and so on, until a level makes no mistake. For
every key of the universe the first level that lacks it tells exactly whether it is listed.

A row is judged by a few array lookups. While the first level has at most ``SHARD_BITS`` bits, each
level is one row used as a scalar, and no join is needed. Longer lists are split by a hash of the
key into shards; a shard's levels are one row of the distributed table, which the shard's rows meet
by an equality of shard and salt (``SALTS`` copies, so that a hot key is spread). Building and
judging take the same number of passes however many shards there are, and no bits pass the driver.

Keys beyond the universe may be judged wrongly; callers build the cascade over what they judge.
Null keys are taken as empty strings, repeated keys count once, urls of any length are taken whole,
and with no listed key nothing is listed. Empty tables and extra columns are fine; columns named
``host``, ``path``, ``rule`` or ``verdict`` are replaced.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.names import unused

#: 16 MB for a level without shards; with them, 128 KB for a level of one.
SHARD_BITS, SMALL_SHARD_BITS = 1 << 27, 1 << 20
SALTS = 16
#: The rate of mistakes of later levels.
RATE = 1 / 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that fits, and its verdict; null where none fits. ``rules`` is a short constant."""
    rule, verdict = F, F
    for of in sorted(rules, key=lambda r: (-len(r), r)):
        rule_host, slash, rest = of.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        rule, verdict = rule.when(fits, F.lit(of)), verdict.when(fits, F.lit(rules[of]))
    return rule, verdict


@dataclass
class Level:
    bits: int
    hashes: int
    #: For each shard a row: ``shard`` and ``words``, an array of 64-bit words.
    words: DataFrame


def bits_per_key(rate: float) -> float:
    return -math.log(rate) / math.log(2) ** 2


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position % 64).cast("int"))


def _holds(key: Column, number: int, level: Level, words: Column) -> Column:
    at = _positions(key, number, level.bits, level.hashes)
    found = [F.get(words, F.floor(p / 64).cast("int")).bitwiseAND(_bit(p)) != 0 for p in at]
    out = found[0]
    for one in found[1:]:
        out = out & one
    return out


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both: one column ``key``)."""

    def __init__(self, universe: DataFrame, listed: DataFrame) -> None:
        clean = lambda df, flag: df.select(F.coalesce(F.col("key"), F.lit("")).alias("key"), F.lit(flag).alias("listed"))
        keys = clean(universe, False).unionByName(clean(listed, True)).groupBy("key").agg(F.max("listed").alias("listed")).checkpoint()
        n = {True: 0, False: 0} | {row["listed"]: row["count"] for row in keys.groupBy("listed").count().collect()}
        # the first level is made so tight that about as many unlisted keys pass as there are listed ones
        first = min(RATE, n[True] / max(1, n[False]))
        bits = n[True] * bits_per_key(first) if n[True] else 0
        self.shards = 1 if bits <= SHARD_BITS else math.ceil(bits / SMALL_SHARD_BITS)
        self.levels: list[Level] = []
        alive, own = keys.withColumn("shard", self._shard(F.col("key"))), True
        while n[own]:
            number, rate = len(self.levels) + 1, RATE if self.levels else first
            level = self._level(alive.where(F.col("listed") == own), number, rate)
            self.levels.append(level)
            if self.shards == 1:
                passed = alive.where(_holds(F.col("key"), number, level, level.words.select("words").scalar()))
            else:
                passed = alive.join(level.words, "shard").where(_holds(F.col("key"), number, level, F.col("words"))).drop("words")
            alive = passed.checkpoint()
            n = {True: 0, False: 0} | {row["listed"]: row["count"] for row in alive.groupBy("listed").count().collect()}
            own = not own

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(self.shards)).cast("int") if self.shards > 1 else F.lit(0)

    def _level(self, keys: DataFrame, number: int, rate: float) -> Level:
        most = keys.groupBy("shard").count().agg(F.max("count")).first()[0]
        bits = max(64, math.ceil(most * bits_per_key(rate)))
        hashes = max(1, round(bits / most * math.log(2)))
        at = keys.select("shard", F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("p"))
        set_ = at.groupBy("shard", F.floor(F.col("p") / 64).cast("long").alias("word")).agg(F.bit_or(_bit(F.col("p"))).alias("bits"))
        n_words = bits // 64 + 1
        empty = keys.sparkSession.range(0, n_words * self.shards).select(F.floor(F.col("id") / n_words).cast("int").alias("shard"), (F.col("id") % n_words).alias("word"), F.lit(0).cast("long").alias("bits"))
        pairs = set_.unionByName(empty).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
        line = pairs.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
        return Level(bits, hashes, line.checkpoint())

    def _listed(self, key: Column, words: list[Column]) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(_holds(key, i, self.levels[i - 1], words[i - 1]), out).otherwise(F.lit(i % 2 == 0))
        return out

    def mark(self, df: DataFrame, key: Column, column: str = "listed") -> DataFrame:
        """``df`` and whether each row's key is listed, as ``column``."""
        key = F.coalesce(key, F.lit(""))
        if self.shards == 1:
            return df.withColumn(column, self._listed(key, [level.words.select("words").scalar() for level in self.levels]))
        shard, salt, words = unused(df.columns, "shard"), unused(df.columns, "salt"), unused(df.columns, "words")
        table = None
        for i, level in enumerate(self.levels):
            of = level.words.select(F.col("shard").alias(shard), F.col("words").alias(f"{words}{i}"))
            table = of if table is None else table.join(of, shard)
        table = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = df.withColumn(shard, self._shard(key)).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        kept = [F.col(f"`{c}`") for c in df.columns]
        return rows.join(table, [shard, salt]).select(*kept, self._listed(key, [F.col(f"{words}{i}") for i in range(len(self.levels))]).alias(column))


def filter_urls(spark: SparkSession, pages: DataFrame, listed_urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """All columns of ``pages`` (with ``url``) and ``host``, ``path``, ``rule``, ``verdict``.

    ``listed_urls``: a column ``url``; a page whose host and path are those of a listed url is
    blocked, unless a rule says otherwise.
    """
    host, path = host_and_path(F.col("url"))
    key = F.concat(host, path)
    cascade = Cascade(pages.select(key.alias("key")), listed_urls.select(key.alias("key")))
    rows = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    listed = unused([*rows.columns, "rule", "verdict"], "listed")
    marked = cascade.mark(rows, F.concat("host", "path"), listed)
    return marked.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col(listed), F.lit("block")).otherwise(F.lit("allow")))).drop(listed)

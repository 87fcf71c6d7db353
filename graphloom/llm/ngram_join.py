"""Exact n-gram Jaccard join with PartEnum signatures, down to connected classes.

A document is the set of its distinct n-word shingles (64-bit hashes). Rows with equal sets (told by
128 bits) are one node, named by the number of its first row. Sizes fall into bands whose ends are
``1 / threshold`` apart, so sets that link lie in one band or in neighbours; a node takes part in its
own band and the next. In a band, sets that link differ in at most ``k`` elements. The domain of the
shingles is partitioned into ``k // 2 + 1 + spare`` groups of three parts; in one group at least,
linked sets differ in at most one element, so two of its three parts are equal. Each of the three
pairs of parts is a signature, and linked sets share one. Pairs of empty parts are no signature,
unless more groups than are to spare have one (then the node also takes the signatures of its empty
pairs); so nothing is lost.

Signatures meet packed by hash; those of one node alone go. A bucket of more than ``MOST_MEMBERS``
nodes is split: its members are dealt to blocks, and each two blocks make a bucket for a task of its
own. In a bucket, a pair can link only if its sizes and a parity bitmap (whose differing bits never
exceed the differing elements) allow it. Each bucket gives a spanning forest of its possible links.
Of these, one for each node is verified on the whole sets, then those whose ends are still in
different classes, and last every possible link of a bucket between members of different classes.
After that each possible link was tested or lies within a class: the classes are exact, and no
bucket is ever spelled out in pairs.

Rows are found again by their numbers, which are dealt to the partitions of the scan (``sidecar``):
only texts that are compared are shuffled. So the table must give the same rows in the same
partitions each time (a scan, a checkpoint).

Texts without words and null texts have the empty set, which links with nothing. Texts with fewer
than n words are one shingle; texts of any length are taken whole. Ids may be of any type that has
an order. Null ids take part; a class of null ids alone has the id null. Rows that repeat an id are
nodes by their own texts. Empty tables and extra columns are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sidecar
from graphloom.llm.textblocks import LOWER, blocks, mix, word_hashes

BLOCK = 1 << 20
#: Shingles for each partition of signatures.
PART_SHINGLES = 2_000_000
MOST_MEMBERS = 4_096
_ODD = np.uint64(0xD1342543DE82EF95)
#: Pairs of a group's three parts.
_PAIRS = ((0, 1), (0, 2), (1, 2))


def document_sets(block, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    data = LOWER[block.data]
    starts, ends, first = block.words(data)
    words = word_hashes(data, starts, ends)
    keys = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for i in range(n):
        keys = keys * _ODD + words[i : i + len(keys)]
    keys = mix(keys)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(keys[a : b - n + 1]))
        elif b > a:
            key = np.uint64(b - a)
            for w in words[a:b]:
                key = np.uint64((int(key) * int(_ODD) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([key])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    sums = np.array([mix(shingles).sum(dtype=np.uint64), mix(shingles ^ _ODD).sum(dtype=np.uint64)])
    high, low = mix(sums + np.array([len(shingles)], dtype=np.uint64) * _ODD).view(np.int64).tolist()
    return high, low


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each of as many places as there are elements (a power of two, 256 at least): whether an odd number falls there."""
    size = 1 << max(8, (len(shingles) - 1).bit_length())
    bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def same_length(bits: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the shortest one's length, as rows of 64-bit words. A folded bitmap is that of fewer places."""
    least = min(map(len, bits), default=32)
    rows = []
    for b in bits:
        row = np.frombuffer(b, np.uint64)
        while len(row) * 8 > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        rows.append(row)
    return np.array(rows).reshape(len(bits), least // 8)


def band_ends(largest: int, percent: int) -> np.ndarray:
    """The largest size of each band, up to two bands beyond ``largest``."""
    ends, low = [], 1
    while len(ends) < 2 or ends[-2] < largest:
        ends.append(100 * low // percent)
        low = ends[-1] + 1
    return np.array([*ends, 100 * low // percent], dtype=np.int64)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures and, for each, the index of its set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    ends = band_ends(int(sizes.max()), percent)
    band = np.searchsorted(ends, sizes)
    found, whose = [], []
    for tag in (band, band + 1):
        k = 2 * ends[tag] * (100 - percent) // (100 + percent)
        k[sizes == 0] = 0
        spare = (k >= 6).astype(np.int64)
        groups = np.where(k > 0, k // 2 + 1 + spare, 0)
        first = np.cumsum(groups) - groups
        mine = groups[owner] > 0
        elements, of = flat[mine], owner[mine]
        if not len(elements):
            continue
        place = mix(elements + tag[of].astype(np.uint64) * _ODD)
        group = ((place >> np.uint64(32)) * groups[of].astype(np.uint64)) >> np.uint64(32)
        part = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
        cell = (first[of] + group.astype(np.int64)) * 3 + part.astype(np.int64)
        n_cells = int(groups.sum()) * 3
        filled = np.bincount(cell, minlength=n_cells).reshape(-1, 3)
        low = np.bincount(cell, (elements & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_cells).astype(np.uint64)
        high = np.bincount(cell, (elements >> np.uint64(32)).astype(np.float64), minlength=n_cells).astype(np.uint64)
        content = mix(low * _ODD + mix(high)).reshape(-1, 3)
        content[filled == 0] = 0
        group_owner = np.repeat(np.arange(len(sets)), groups)
        number = (np.arange(len(group_owner)) - first[group_owner]).astype(np.uint64)
        label = mix(tag[group_owner].astype(np.uint64) * np.uint64(1 << 32) + number)
        empty = np.stack([filled[:, a] + filled[:, b] == 0 for a, b in _PAIRS])
        lacking = np.bincount(group_owner, empty.any(axis=0), minlength=len(sets)) > spare
        for i, (a, b) in enumerate(_PAIRS):
            taken = ~empty[i] | lacking[group_owner]
            both = mix(content[:, a] * _ODD + mix(content[:, b] + np.uint64(i + 1)) + label)
            found.append(both[taken])
            whose.append(group_owner[taken])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """A scan partition's batches, each with the number of its first row."""
    number = TaskContext.get().partitionId() << sidecar.ROWS_BITS
    for batch in batches:
        yield batch, number
        number += batch.num_rows


def dealt_rows(rows: DataFrame, folder: str) -> None:
    """Deals row numbers (``row``) and the bytes of their texts (``size``, null if unknown) to their scan partitions."""
    sidecar.deal(rows.select("row", "size", F.expr(f"cast(shiftright(row, {sidecar.ROWS_BITS}) as int)").alias("scan")), folder, "row")


class Dealt:
    """The rows dealt to this task's partition."""

    def __init__(self, folder: str) -> None:
        table = sidecar.dealt_to(folder)
        rows, sizes = (np.zeros(0, np.int64),) * 2 if table is None else (table["row"].to_numpy(), table["size"].fill_null(-1).to_numpy())
        order = np.argsort(rows)
        self.rows, self.sizes = rows[order], sizes[order]

    def among(self, number: int, texts: pa.Array) -> np.ndarray:
        """Places in a batch whose first row has that number. A text of another size than it had is found out."""
        a, b = np.searchsorted(self.rows, [number, number + len(texts)])
        places = self.rows[a:b] - number
        now = pc.fill_null(pc.binary_length(texts.take(pa.array(places))), 0).to_numpy()
        if ((self.sizes[a:b] >= 0) & (now != self.sizes[a:b])).any():
            raise ValueError("the table's partitions changed between two readings; checkpoint it")
        return places


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """``row``, ``size`` (bytes of the text), ``doc_id``, ``high``, ``low`` (null for the empty set), ``n_shingles``, ``bits``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, number in numbered(batches):
            for block in blocks(batch.column(1), BLOCK):
                sets = document_sets(block, n)
                high, low = zip(*(set_hashes(s) if len(s) else (None, None) for s in sets), strict=True)
                columns = [
                    pa.array(number + np.arange(block.rows.start, block.rows.stop)), pa.array(np.diff(block.offsets)), batch.column(0).slice(block.rows.start, block.size), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "size", "doc_id", "high", "low", "n_shingles", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"row long, size long, doc_id {kind}, high long, low long, n_shingles long, bits binary")


def _messages(docs: DataFrame, n: int, percent: int, shift: int, folder: str) -> DataFrame:
    """A block's signatures for each partition of the hash space: low 40 bits, and places in a table of nodes.

    Only the rows that name a node (those dealt to ``folder``) have signatures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Dealt(folder)
        for batch, number in numbered(batches):
            places = mine.among(number, batch.column(0))
            for block in blocks(batch.column(0).take(pa.array(places)), BLOCK):
                nodes = number + places[block.rows]
                found, whose = signatures(document_sets(block, n), percent)
                if not len(found):
                    continue
                order = np.argsort(found)
                found, whose = found[order], whose[order]
                part = (found >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(found), np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                rows = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    used, place = np.unique(whose[a:b], return_inverse=True)
                    narrow = np.uint16 if len(used) < 1 << 16 else np.uint32
                    low = found[a:b]
                    rows.append((int(part[a]), low.astype(np.uint32).tobytes(), (low >> np.uint64(32)).astype(np.uint8).tobytes(), place.astype(narrow).tobytes(), nodes[used].tobytes()))
                kinds = [pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "low", "high", "place", "nodes"])

    return docs.select("text").mapInArrow(run, "part long, low binary, high binary, place binary, nodes binary")


def _unpack(low: bytes, high: bytes, place: bytes, nodes: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(low, np.uint32)
    at = np.frombuffer(place, np.uint16 if len(place) == 2 * len(a) else np.uint32)
    return a.astype(np.int64) | np.frombuffer(high, np.uint8).astype(np.int64) << 32, np.frombuffer(nodes, np.int64)[at]


def _shared(messages: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (a hash of its members) and node, for signatures of more than one node."""
    total = sum(len(m[1]) for m in messages)
    keys, nodes, at = np.empty(total, np.int64), np.empty(total, np.int64), 0
    for m in messages:
        n = len(m[1])
        keys[at : at + n], nodes[at : at + n] = _unpack(*m)
        at += n
    # most signatures are of one place only: these go before anything is sorted by node
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    del order
    twin = np.zeros(total, dtype=bool)
    twin[1:] = keys[1:] == keys[:-1]
    twin[:-1] |= twin[1:]
    keys, nodes = keys[twin], nodes[twin]
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    if not (sizes > 1).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    members = np.add.reduceat(mix(nodes.view(np.uint64)), starts)
    _, once = np.unique(members, return_index=True)
    once = once[sizes[once] > 1]
    at = np.concatenate([np.arange(s, s + c) for s, c in zip(starts[once].tolist(), sizes[once].tolist(), strict=True)]) if len(once) else np.zeros(0, np.int64)
    return np.repeat(members[once], sizes[once]).view(np.int64), nodes[at]


def _buckets(messages: DataFrame, parts: int) -> DataFrame:
    dealt = messages.repartition(parts, "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def out() -> Iterator[pa.RecordBatch]:
            bucket, node = _shared(held)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node)], names=["bucket", "node"])

        for batch in batches:
            for part, *message in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and part != at:
                    yield from out()
                    held = []
                at = part
                held.append(tuple(message))
        if held:
            yield from out()

    return dealt.mapInArrow(run, "bucket long, node long").distinct()


def split_buckets(buckets: DataFrame) -> DataFrame:
    """The same buckets, each of more than ``MOST_MEMBERS`` members as one for every two of its blocks (and for each with itself).

    Two members of a bucket still share one, and no bucket has more than about twice as many members.
    """
    large = buckets.groupBy("bucket").count().where(F.col("count") > MOST_MEMBERS).select("bucket", F.ceil(F.col("count") / MOST_MEMBERS).cast("int").alias("n")).checkpoint()
    if large.isEmpty():
        return buckets
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("mine")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    dealt = buckets.join(large, "bucket").select("bucket", "node", mine, "n").select("bucket", "node", "mine", other)
    pairs = dealt.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "node")
    return buckets.join(large, "bucket", "left_anti").unionByName(pairs).checkpoint()


def possible(sizes: np.ndarray, bits: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` may link with ``i``: never false for a pair that does."""
    total = sizes[others] + sizes[i]
    apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
    return (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])) & ((100 + percent) * apart <= (100 - percent) * total)


def spanning_forest(sizes: np.ndarray, bits: np.ndarray, percent: int) -> list[tuple[int, int]]:
    edges, left = [], np.arange(len(sizes))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop(0)
            hit = possible(sizes, bits, i, left, percent)
            if hit.any():
                edges += [(i, int(j)) for j in left[hit]]
                queue += left[hit].tolist()
                left = left[~hit]
    return edges


def crossing(sizes: np.ndarray, bits: np.ndarray, classes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    edges, places = [], np.arange(len(sizes))
    for i in range(len(sizes) - 1):
        later = places[i + 1 :][classes[i + 1 :] != classes[i]]
        if len(later):
            edges += [(i, int(j)) for j in later[possible(sizes, bits, i, later, percent)]]
    return edges


def _candidates(members: DataFrame, percent: int, cross: bool) -> DataFrame:
    """Possible links in each bucket, from ``a`` to ``b``. ``members``: bucket, node, n, bits, class."""
    dealt = members.select("bucket", "node", "n", "bits", "class").repartition("bucket").sortWithinPartitions("bucket", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        edges: list[tuple[int, int]] = []

        def work(of: pa.Table) -> None:
            bucket = of["bucket"].to_numpy()
            nodes, sizes, classes = (of[c].to_numpy() for c in ("node", "n", "class"))
            bits = of["bits"].to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = same_length(bits[a:b])
                found = crossing(sizes[a:b], rows, classes[a:b], percent) if cross else spanning_forest(sizes[a:b], rows, percent)
                edges.extend((int(nodes[a + i]), int(nodes[a + j])) for i, j in found)

        def out() -> pa.RecordBatch:
            rows = np.array(edges, dtype=np.int64).reshape(-1, 2)
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=["a", "b"])

        for batch in batches:
            of = pa.Table.from_batches([batch])
            of = pa.concat_tables([rest, of]) if rest is not None else of
            bucket = of["bucket"].to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if whole:
                work(of.slice(0, whole))
            rest = of.slice(whole)
            if edges:
                yield out()
        if rest is not None and len(rest):
            work(rest)
        if edges:
            yield out()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``text`` of ``nodes``, which are numbers of rows."""
    folder = sidecar.new_folder(docs.sparkSession, "ngram-texts")
    dealt_rows(nodes.select(F.col("node").alias("row"), F.lit(None).cast("long").alias("size")), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Dealt(folder)
        for batch, number in numbered(batches):
            places = mine.among(number, batch.column(0))
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array(number + places), batch.column(0).take(pa.array(places))], names=["node", "text"])

    return docs.select("text").mapInArrow(run, "node long, text string")


def _verified(edges: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The edges whose whole sets link. Texts travel, being smaller than their sets; a set is made where it is compared."""
    edges = edges.select("a", "b").distinct()
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    texts = _texts(docs, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                left, right = ([s for block in blocks(part.column(c)) for s in document_sets(block, n)] for c in (2, 3))
                for x, y in zip(left, right, strict=True):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    one, other = (texts.select(F.col("node").alias(x), F.col("text").alias(f"of_{x}")) for x in "ab")
    pairs = edges.join(one, "a").join(other, "b").select("a", "b", "of_a", "of_b")
    return pairs.mapInArrow(run, "a long, b long").checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``class`` (its component's smallest node), by alternating large and small stars."""
    edges = edges.select("a", "b").where("a <> b").distinct().checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m", "a")
        edges = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("class"))
        before = now


def _classed_rows(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows as ``_rows`` gives them, and for each set ``high``, ``low``, its class's smallest id (``component_id``) and that id's row and size."""
    rows = _rows(docs, n).checkpoint()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "size")).alias("best")
    nodes = rows.where(F.col("high").isNotNull()).groupBy("high", "low").agg(F.min(F.struct("row", "size")).alias("first"), best, F.max("n_shingles").alias("n"), F.max("bits").alias("bits")).withColumn("node", F.col("first.row")).checkpoint()
    total = nodes.agg(F.sum("n")).first()[0] or 0
    shift = max(3, (total // PART_SHINGLES).bit_length())
    folder = sidecar.new_folder(docs.sparkSession, "ngram-nodes")
    dealt_rows(nodes.select("first.*"), folder)
    buckets = split_buckets(_buckets(_messages(docs, n, percent, shift, folder), 1 << shift).checkpoint())
    tested = _candidates(buckets.join(nodes, "node").withColumn("class", F.col("node")), percent, cross=False).checkpoint()

    def across(edges: DataFrame, classes: DataFrame) -> DataFrame:
        """The edges whose ends are in different classes."""
        for end in "ab":
            of = classes.select(F.col("node").alias(end), F.col("class").alias(f"class_{end}"))
            edges = edges.join(of, end, "left").withColumn(f"class_{end}", F.coalesce(f"class_{end}", end))
        return edges.where("class_a <> class_b").select("a", "b")

    # first one link for each node, to the smallest; most others then lie within a class
    first = tested.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").checkpoint()
    links = _verified(first, docs, n, percent)
    classes = connected(links)
    rest = across(tested.join(first, ["a", "b"], "left_anti"), classes).checkpoint()
    links = links.unionByName(_verified(rest, docs, n, percent))
    classes = connected(links)

    classed = buckets.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    open_ = classed.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("bucket")
    members = classed.join(open_, "bucket", "left_semi").join(nodes, "node")
    known = first.unionByName(rest)
    known = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = _candidates(members, percent, cross=True).select("a", "b").join(known, ["a", "b"], "left_anti").checkpoint()
    found = _verified(more, docs, n, percent)
    if found.limit(1).count():
        classes = connected(links.unionByName(found))
    labelled = nodes.select("high", "low", "node", "best").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = labelled.groupBy("class").agg(F.min("best").alias("least"))
    return rows, labelled.join(least, "class").select("high", "low", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("row"), F.col("least.size").alias("size"))


def join_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id of the class) for each row."""
    rows, sets = _classed_rows(docs, n, percent)
    # the empty set stands alone
    alone = rows.where(F.col("high").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where(F.col("high").isNotNull()).join(sets.drop("row", "size"), ["high", "low"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, with its own columns: the first in the table of those of the smallest id. Wordless texts all stay."""
    rows, sets = _classed_rows(docs, n, percent)
    folder = sidecar.new_folder(docs.sparkSession, "ngram-kept")
    dealt_rows(sets.select("row", "size").distinct().unionByName(rows.where(F.col("high").isNull()).select("row", "size")), folder)
    text = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Dealt(folder)
        for batch, number in numbered(batches):
            places = mine.among(number, batch.column(text))
            if len(places):
                yield batch.take(pa.array(places))

    return docs.mapInArrow(run, docs.schema)

"""Packing of documents into training sequences by the sum-of-squares rule.

A document is its tokens and a closing id. Whole windows of ``window`` ids are cut off first; the
rest is placed online. A level array counts the partially filled windows at each fill level, and
the rest goes to the level (or a new window) after which the sum of the squared counts is least;
in a tie the fullest window wins. The choice looks only at the level array, not at the windows.

Each task packs the rows of its own input partition and writes the full windows. The rests in its
open windows (all of them, once more than ``MOST_OPEN`` are open) are placed again, by the same rule
and the largest first, together with those of ``FAN`` neighbouring partitions, so small partitions
don't hold many windows open. What is then still open is closed: the fullest windows stay as they
are and are filled up with ids of the emptiest ones; only these are cut anew. What is left over at
the end is cut into sequences whose lengths are powers of two, which need no padding.

Only the rests of open windows are shuffled, and memory is bounded by the open windows and one
document. ``sequence_id`` carries the number of the partition (of the group, from 2 ** 62 on) in its
upper half. A lost task packs the same rows into the same sequences again; what the first step
gives is kept as Parquet in the checkpoint folder.

Null texts count as empty: such a document is the closing id alone. Texts of any length are taken
whole. Repeated ids are packed like any other rows. An empty table gives no pieces. Only the id and
text columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sidecar
from graphloom.llm.textblocks import blocks

MOST_OPEN, FAN = 4096, 4
SPECIAL = "<|endoftext|>"
#: Code points below this are classed alike by every Unicode version that the two libraries use.
_BEYOND = re.compile("[^\x00-ɏ]")


@lru_cache(maxsize=2)
def _plain(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=2)
def _fast(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, json_path: str, ranks_path: str | None = None) -> np.ndarray:
    """The ids of ``Tokenizer.from_file(json_path).encode(text, add_special_tokens=False)``.

    ``ranks_path``: the same vocabulary as ranks; texts for which both libraries must agree
    (no special token's string, no code point from U+0250 on) take that four times faster way.
    A task loads what its texts need.
    """
    if ranks_path is not None and SPECIAL not in text and not _BEYOND.search(text):
        return _fast(ranks_path).encode_to_numpy(text)
    return np.array(_plain(json_path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class Packer:
    """The level array and the open windows of one task or group."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.next = window, first_sequence
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.pieces: list[tuple] = []
        #: Ids placed by the rule, and those that ``close`` took out of their windows.
        self.placed = self.moved = 0

    def _emit(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.pieces.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _level_for(self, size: int) -> int:
        """The level, 0 for a new window, after which the sum of squares is least."""
        full = self.window
        from_ = np.flatnonzero(self.levels[1 : full + 1 - size]) + 1
        new = 2 * self.levels[size] + 1
        if not len(from_):
            return 0
        to = self.levels[from_ + size]
        change = np.where(from_ + size == full, 0, 2 * to + 1) + 1 - 2 * self.levels[from_]
        best = len(from_) - 1 - int(change[::-1].argmin())
        return int(from_[best]) if change[best] <= new else 0

    def add(self, doc, ids: np.ndarray) -> None:
        """A whole document: full windows are cut off, the rest is placed."""
        total = len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._emit([(doc, start, ids[start : start + self.window], total)])
        if whole < total:
            self.place(doc, whole, ids[whole:], total)

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        size = len(ids)
        self.placed += size
        level = self._level_for(size)
        held = []
        if level:
            held = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        held.append((doc, start, ids, total))
        if level + size == self.window:
            self._emit(held)
            return
        self.open.setdefault(level + size, []).append(held)
        self.levels[level + size] += 1
        self.n_open += 1

    def take_open(self) -> list[list]:
        """The open windows, the fullest first; none is open any more."""
        windows = [held for level in sorted(self.open, reverse=True) for held in self.open[level]]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        return windows

    def close(self) -> None:
        """Fill the fullest open windows with the ids of the emptiest ones."""
        windows = self.take_open()
        spare: list[tuple] = []
        i, j = 0, len(windows)
        while i < j:
            held, room = windows[i], self.window - sum(len(p[2]) for p in windows[i])
            while room and (spare or i < j - 1):
                if not spare:
                    j -= 1
                    spare = windows[j][::-1]
                    self.moved += sum(len(p[2]) for p in spare)
                doc, start, ids, total = spare.pop()
                held.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                room -= len(held[-1][2])
            if room:
                spare = held[::-1]
            else:
                self._emit(held)
            i += 1
        left = sum(len(p[2]) for p in spare)
        while left:
            held, room = [], 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, ids, total = spare.pop()
                held.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                room -= len(held[-1][2])
            self._emit(held)


_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, window: int = 1024, closing_id: int = 0) -> DataFrame:
    """One row per piece; ``ids`` holds its ids as little-endian unsigned 32-bit numbers."""
    source = docs.select("doc_id", "text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {_PIECE}"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]

    def rows_of(pieces: list[tuple], kind: pa.DataType, **more: int) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*pieces, strict=True), [kind, *types], strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([v] * len(pieces), pa.int64()) for v in more.values())], names=[*names, *more])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(window, task << 32)
        closing = np.array([closing_id], dtype=np.uint32)
        kind = None

        def handed_on() -> Iterator[pa.RecordBatch]:
            rests = [(doc, start, len(ids), ids.astype("<u4").tobytes(), total, None, None) for held in packer.take_open() for doc, start, ids, total in held]
            if rests:
                yield rows_of(rests, kind, group=task // FAN)

        for batch in batches:
            kind = batch.column(0).type
            for block in blocks(batch.column(1)):
                keys = batch.column(0).slice(block.rows.start, block.size).to_pylist()
                data = block.data.tobytes()
                for key, a, b in zip(keys, block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
                    packer.add(key, np.concatenate([encode(data[a:b].decode("utf-8"), json_path, ranks_path), closing]))
                    if packer.n_open > MOST_OPEN:
                        yield from handed_on()
                if packer.pieces:
                    yield rows_of(packer.pieces, kind, group=-1)
                    packer.pieces = []
        yield from handed_on()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = None, None
        for batch in batches:
            kind = batch.column(0).type
            for group, doc, start, ids, total in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("group", "doc_id", "start", "ids", "doc_tokens")), strict=True):
                if group != at:
                    if packer is not None:
                        packer.close()
                        if packer.pieces:
                            yield rows_of(packer.pieces, kind)
                    packer, at = Packer(window, (1 << 62) + (group << 32)), group
                packer.place(doc, start, np.frombuffer(ids, "<u4"), total)
                if packer.n_open > MOST_OPEN:
                    packer.close()
            if packer is not None and packer.pieces:
                yield rows_of(packer.pieces, kind)
                packer.pieces = []
        if packer is not None:
            packer.close()
            if packer.pieces:
                yield rows_of(packer.pieces, kind)

    spark, folder = docs.sparkSession, sidecar.new_folder(docs.sparkSession, "packing")
    source.mapInArrow(first, f"{schema}, group long").write.parquet(folder)
    pieces = spark.read.schema(f"{schema}, group long").parquet(folder)
    rests = pieces.where("group >= 0").repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "ids", "doc_tokens")
    return pieces.where("group < 0").select(names).unionByName(rests.mapInArrow(second, schema))

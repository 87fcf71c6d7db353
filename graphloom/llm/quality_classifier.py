"""Byte-level convolutional quality classifier in numpy.

The text's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Each byte
is looked up in a learned embedding; learned filters slide over the chunk, are rectified and
max-pooled; the chunks' pooled values are averaged over the document and a logistic unit turns
them, with the share of padding, into one probability. Only the bytes are an input.

Training uses a bounded sample of labelled rows (``TRAIN_PER_CLASS`` for each label, chosen by a
hash of the id), from rows of which ``learn_from`` holds. Of each of these texts the driver gets its
chunks, or ``TRAIN_CHUNKS`` drawn by a hash from all of them where there are more: a longer text is
sampled over its whole length, and memory stays bounded. Scoring covers every byte of every row and
needs no shuffle.

Null and empty texts are scored as one chunk of padding. With no usable labels of either class
the score is 0.5 plus a sign of the known class: 1.0 or 0.0 for one class alone, 0.5 for none.
Repeated labels count once (the lowest quality of a document), repeated rows of an id train with the
text of the smallest hash; labels without a document are ignored; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.names import unused
from graphloom.llm.textblocks import blocks

TRAIN_PER_CLASS = 1500
TRAIN_CHUNKS = 96
DECAY = 1e-4
CHUNK, STEP = 512, 384
WIDTH, STRIDE, EMBED, FILTERS = 8, 4, 8, 48
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    """``embedding``: 257 x EMBED (the last row is padding); ``filters``: WIDTH * EMBED x FILTERS."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    constant: float | None = None

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks (n x CHUNK byte codes) to windows (n x POSITIONS x WIDTH * EMBED) and filter values."""
        x = self.embedding[chunks].reshape(len(chunks), CHUNK * EMBED)
        windows = np.lib.stride_tricks.as_strided(x, (len(chunks), POSITIONS, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * x.itemsize, x.itemsize))
        values = windows.reshape(-1, WIDTH * EMBED) @ self.filters
        return windows, values.reshape(len(chunks), POSITIONS, FILTERS)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability for each document of a block."""
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        starts, owner = chunk_starts(offsets)
        padded = np.full(len(data) + CHUNK, 256, dtype=np.int16)
        padded[: len(data)] = data
        ends = offsets[1:][owner]
        total = np.zeros((n, FILTERS + 2), dtype=np.float32)
        for i in range(0, len(starts), 256):
            at = starts[i : i + 256]
            chunks = padded[at[:, None] + np.arange(CHUNK)]
            short = at + CHUNK > ends[i : i + 256]
            if short.any():
                chunks[short] = np.where(at[short][:, None] + np.arange(CHUNK) < ends[i : i + 256][short][:, None], chunks[short], 256)
            top = np.maximum(self.pooled(chunks)[1].max(axis=1) + self.bias, 0)
            filled = np.minimum(ends[i : i + 256] - at, CHUNK)
            np.add.at(total, owner[i : i + 256], np.hstack([top, emptiness(filled)]))
        mean = total / np.bincount(owner, minlength=n)[:, None]
        z = np.clip(mean.astype(np.float64) @ self.weights + self.offset, -60, 60)
        return 1 / (1 + np.exp(-z))


def emptiness(filled: np.ndarray) -> np.ndarray:
    """Two inputs beside the pooled filters: how little text a chunk has, since few windows give low maxima."""
    return np.stack([1 - filled / CHUNK, 40 / (40 + filled)], axis=1)


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of each document begin, and whose they are; every byte is in one or two of a document's chunks."""
    lengths = np.diff(offsets)
    per = np.maximum(1, -(-(lengths - CHUNK) // STEP) + 1)
    owner = np.repeat(np.arange(len(lengths)), per)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return offsets[:-1][owner] + rank * STEP, owner


def gradients(net: Network, chunks: np.ndarray, share: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted logistic loss (and the decay of the last weights) over texts of ``len(share) / len(y)`` chunks each.

    ``share``: each chunk's part in its text's mean, 0 for chunks that aren't there.
    """
    batch, per_text = len(y), len(share) // len(y)
    windows, values = net.pooled(chunks)
    best = values.argmax(axis=1)
    top = np.take_along_axis(values, best[:, None, :], axis=1)[:, 0] + net.bias
    inputs = np.hstack([np.maximum(top, 0), emptiness((chunks < 256).sum(axis=1))]) * share[:, None]
    feature = inputs.reshape(batch, per_text, FILTERS + 2).sum(axis=1)
    z = np.clip(feature @ net.weights + net.offset, -60, 60)
    error = (1 / (1 + np.exp(-z)) - y) / batch * weight
    d_top = (np.repeat(error, per_text)[:, None] * net.weights[None, :FILTERS] * share[:, None]) * (top > 0)
    picked = windows[np.arange(len(chunks))[:, None], best]
    grads = {"weights": feature.T @ error + DECAY * net.weights, "offset": error.sum(), "bias": d_top.sum(axis=0)}
    grads["filters"] = np.einsum("cfw,cf->wf", picked, d_top)
    d_window = (d_top[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    at = best[:, :, None] * STRIDE + np.arange(WIDTH)
    bytes_ = np.take_along_axis(chunks, at.reshape(len(chunks), -1), axis=1).reshape(-1)
    grads["embedding"] = np.stack([np.bincount(bytes_, d_window[:, e], minlength=257) for e in range(EMBED)], axis=1)
    return grads


def chunks_of(text: bytes) -> list[bytes]:
    starts, _ = chunk_starts(np.array([0, len(text)]))
    return [text[s : s + CHUNK] for s in starts]


def fit(texts: list[list[bytes]], labels: np.ndarray, steps: int = 800, batch: int = 48, per_text: int = 6, seed: int = 17) -> Network:
    """Adam on the logistic loss, with equal numbers of both labels; a good text lost weighs half as much again.

    ``texts``: chunks of each text, as ``chunks_of`` gives them.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (257, EMBED)).astype(np.float32), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS + 2), 0.0
    )
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        net.constant = 0.5 if not len(labels) else float(labels[0])
        return net
    by_label = [np.flatnonzero(labels == y) for y in (0, 1)]
    encoded = [[np.frombuffer(c, dtype=np.uint8) for c in chunks] for chunks in texts]
    names = ("embedding", "filters", "bias", "weights", "offset")
    moments = {k: [0.0, 0.0] for k in names}
    for step in range(1, steps + 1):
        half = batch // 2
        rows = np.concatenate([rng.choice(of, half) for of in by_label])
        y = np.repeat([0.0, 1.0], half)
        chunks = np.full((batch * per_text, CHUNK), 256, dtype=np.int16)
        used = np.zeros((batch, per_text))
        for i, row in enumerate(rows):
            of = encoded[row]
            for j, c in enumerate(range(len(of)) if len(of) <= per_text else rng.choice(len(of), per_text, replace=False)):
                piece = of[c]
                chunks[i * per_text + j, : len(piece)] = piece
                used[i, j] = 1
        share = (used / used.sum(axis=1, keepdims=True)).reshape(-1)
        grads = gradients(net, chunks, share, y, np.where(y == 1, 1.5, 1.0))
        rate = 0.01 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k in names:
            m, v = moments[k]
            moments[k] = m, v = 0.9 * m + 0.1 * grads[k], 0.99 * v + 0.01 * np.square(grads[k])
            change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            value = getattr(net, k) - change
            setattr(net, k, value.astype(np.float32) if k in ("embedding", "filters", "bias") else value)
    return net


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = TRAIN_PER_CLASS) -> Network:
    """Fit on at most ``per_class`` rows of each label; ``learn_from`` is a condition on ``doc_id``."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn_from).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # the heads of two orders: at most 2 * per_class rows, which a broadcast may hold
    sample = marks.where("quality = 0").orderBy(*order).limit(per_class).unionByName(marks.where("quality = 1").orderBy(*order).limit(per_class))
    # chunks are numbered over the whole text; of more than TRAIN_CHUNKS a hash draws as many numbers
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    n = F.greatest(F.lit(1), F.ceil((F.octet_length(text) - CHUNK) / F.lit(float(STEP))).cast("int") + 1)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_CHUNKS - 1)), lambda i: F.pmod(F.xxhash64(F.col("doc_id"), i), n).cast("int"))
    numbers = F.when(n <= TRAIN_CHUNKS, F.sequence(F.lit(0), n - 1)).otherwise(drawn)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", text.alias("bytes"), numbers.alias("numbers"), F.xxhash64("text").alias("hash"))
    pieces = F.transform("numbers", lambda i: F.substring(F.col("bytes"), i * STEP + 1, F.lit(CHUNK)))
    rows = found.select("doc_id", "quality", pieces.alias("chunks"), "hash").groupBy("doc_id").agg(F.min_by(F.struct("quality", "chunks"), "hash").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([[bytes(c) for c in r["x"]["chunks"]] for r in rows], np.array([r["x"]["quality"] for r in rows], dtype=int))


def score(docs: DataFrame, network: Network, column: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1."""
    if column in docs.columns:
        docs = docs.drop(column)
    at, names = docs.columns.index(text), [*docs.columns, column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{column}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                found = network.scores(block.data, block.offsets)
                yield pa.RecordBatch.from_arrays([*batch.slice(block.rows.start, block.size).columns, pa.array(found, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def keep_documents(docs: DataFrame, labels: DataFrame, learn_from: Column, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with their own columns."""
    column = unused(docs.columns, "quality_score")
    network = train(docs, labels, learn_from)
    return score(docs, network, column).where(F.col(column) >= least).drop(column)

"""Exact top-k search by inner product with a vector-approximation file.

Vectors are whole numbers, floor(scale * x). Candidates come in blocks. In a block each dimension
is quantised into ``2 ** bits`` cells; a scan of the cells bounds every score from above (the
distance, its negative, from below). Exact vectors are then read in the order of these bounds,
``STEP`` at a time for each query, until the k-th score found so far is above the next bound.

The queries are a stated part of the rows and grow with them. They are searched in groups of about
``GROUP``, which is what the driver and a task hold at a time; each group is one pass over the
candidates whose few results are kept in the checkpoint folder.

Vectors that are null, empty, or hold null or non-finite components take no part; vectors of
another length than the query's are no candidates of it. Rows without an id can't be queries but
can be found, as id null, after all others of their score. Repeated rows are candidates each; all
rows with the query's id count as the query's own; several vectors of one query id count as the
least of them. No queries or no candidates: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUP = 8192
BLOCK, STEP, BITS = 4096, 64, 6
QUERY_ROWS = 256
_NO_ID = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``v``, for the rows that take part."""
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0)
    sound = sound & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(sound).select("vec_id", F.transform(vector, lambda x: F.floor(scale * x.cast("double"))).alias("v"))


class Search:
    """The best k so far of each of a group's queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), _NO_ID)
        self.filled = np.zeros((len(ids), k), dtype=bool)
        self.most = int(np.abs(vectors).max(initial=0))

    def _exact(self, rows: np.ndarray, at: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.einsum("qd,qmd->qm", self.vectors[rows], block[at])

    def _merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        scores = np.hstack([self.scores[rows], scores])
        ids = np.hstack([self.found[rows], ids])
        valid = np.hstack([self.filled[rows], valid])
        order = np.lexsort((ids, -scores, ~valid), axis=1)[:, : self.k]
        for mine, new in ((self.scores, scores), (self.found, ids), (self.filled, valid)):
            mine[rows] = np.take_along_axis(new, order, axis=1)

    def scan(self, ids: np.ndarray, block: np.ndarray) -> None:
        # cells: bounds of each candidate's components, from its code alone
        low, high = block.min(axis=0), block.max(axis=0)
        width = (high - low) // (1 << BITS) + 1
        codes = ((block - low) // width).astype(np.uint8)
        below = (low + codes * width).astype(np.float64)
        above = np.minimum(below + (width - 1), high)
        # beyond this doubles round; then every candidate is read
        sure = self.most * int(np.abs(block).max(initial=0)) * block.shape[1] < 1 << 52
        for i in range(0, len(self.ids), QUERY_ROWS):
            rows = np.arange(i, min(i + QUERY_ROWS, len(self.ids)))
            q = self.vectors[rows].astype(np.float64)
            bound = np.maximum(q, 0) @ above.T + np.minimum(q, 0) @ below.T if sure else np.full((len(rows), len(ids)), np.inf)
            bound[self.ids[rows][:, None] == ids[None, :]] = -np.inf
            while True:
                full = self.filled[rows].all(axis=1)
                least = np.where(full, self.scores[rows][:, -1], -np.inf)
                open_ = (bound >= least[:, None]) & (bound > -np.inf)
                still = np.flatnonzero(open_.any(axis=1))
                if not len(still):
                    break
                rows, bound = rows[still], bound[still]
                step = min(STEP, len(ids))
                at = np.argpartition(-bound, step - 1, axis=1)[:, :step]
                read = np.take_along_axis(bound, at, axis=1) > -np.inf
                self._merge(rows, self._exact(rows, at, block), ids[at], read)
                np.put_along_axis(bound, at, -np.inf, axis=1)


def search(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for each query (both inputs: ``vec_id``, ``v``)."""
    asked = queries.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")).checkpoint()
    groups = max(1, -(-asked.count() // GROUP))
    out = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).collect()
        found = _pass(candidates, [(r["vec_id"], r["v"]) for r in rows], k).checkpoint()
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(candidates: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """The best k of each task for each query."""
    by_length: dict[int, list[tuple[int, list[int]]]] = {}
    for key, v in queries:
        by_length.setdefault(len(v), []).append((key, v))
    packed = {n: (np.array([x[0] for x in q], dtype=np.int64), np.array([x[1] for x in q], dtype=np.int64)) for n, q in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {n: Search(ids, vectors, k) for n, (ids, vectors) in packed.items()}
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                lengths = part.column(1).value_lengths().to_numpy()
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(lengths) - lengths
                for n, of in searches.items():
                    mine = np.flatnonzero(lengths == n)
                    if len(mine):
                        of.scan(ids[mine], flat[starts[mine][:, None] + np.arange(n)])
        for of in searches.values():
            rows, places = np.nonzero(of.filled)
            if len(rows):
                found = of.found[rows, places]
                columns = [pa.array(of.ids[rows]), pa.array(found, mask=found == _NO_ID), pa.array(of.scores[rows, places])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return candidates.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")



"""Exact top-k inner products over an impact-ordered index, a score at a time.

Vectors become whole numbers. Rows are dealt into blocks of bounded size; in a block every dimension has a posting list
in order of the component, cut into segments whose postings have quantised impact: the segment's bounds. A query takes
segments of all dimensions by descending possible gain, adds exact products to its accumulators and keeps what the rest
could still add; it stops only when that proves that no further row can enter, and then scores the possible members
exactly. The blocks' results are merged per query.

Cases: vectors that are null or hold null or non-finite components take no part, as query or as candidate; ties go to
the smaller id; repeated ids are all kept; vectors of another length than a query's are not comparable and take no part
for it; fewer candidates than k give all of them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE, K = 1024, 10
#: Candidates of a block, queries of a block, and segments of a posting list.
BLOCK_ROWS, QUERY_ROWS, SEGMENTS = 4096, 2048, 16
#: How often a search looks for a proof.
ROUNDS = 4


def whole_numbers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Key and v (floor(scale * x) of each component) of the rows that take part."""
    v = F.col(column)
    fine = v.isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(fine).select(F.col(key).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class Index:
    """Impact-ordered posting segments of a block of vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, segments: int = SEGMENTS):
        self.ids, self.rows = ids, rows
        n, dims = rows.shape
        order = np.argsort(rows, axis=0, kind="stable")  # ascending component, by dimension
        values = np.take_along_axis(rows, order, axis=0).astype(np.float64)
        #: Posting lists: rows and components of each dimension.
        self.order, self.values = np.ascontiguousarray(order.T), np.ascontiguousarray(values.T)
        self.cuts = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(int))
        self.segments = len(self.cuts) - 1
        #: Quantised impact: the least and the greatest component of a segment, (segment, dimension).
        self.low, self.high = values[self.cuts[:-1]], values[self.cuts[1:] - 1]
        #: Segment of each row in each dimension.
        self.segment = np.empty((n, dims), np.uint8)
        np.put_along_axis(self.segment, order, np.repeat(np.arange(self.segments), np.diff(self.cuts))[:, None].astype(np.uint8), axis=0)

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, greatest score first, ties by id; rows whose id is ``own`` take no part."""
        alive = np.ones(len(self.ids), bool) if own is None else self.ids != own
        n, dims = int(alive.sum()), self.rows.shape[1]
        if n <= k or not dims:
            return self._exact(np.flatnonzero(alive), query, k)
        last = self.segments
        rising = query >= 0
        gain = np.where(rising, self.high, self.low) * query  # most that a posting of the segment adds
        least = np.where(rising, self.low[0], self.high[-1]) * query
        # segments by impact, gain above the dimension's least; along a dimension gains fall, so a prefix of it is taken
        turn = np.argsort(-(gain - least), axis=None, kind="stable") % dims
        taken, score = np.zeros(dims, np.int64), np.zeros(len(self.ids))
        step = -(-len(turn) // ROUNDS)
        for upto in range(step, len(turn) + step, step):
            before, taken = taken, np.bincount(turn[:upto], minlength=dims)
            start = np.where(rising, last - taken, before)
            end = np.where(rising, last - before, taken)
            spans = [(self.cuts[a], self.cuts[b], d) for d, (a, b) in enumerate(zip(start.tolist(), end.tolist())) if a < b]
            postings = np.concatenate([self.order[d, a:b] for a, b, d in spans])
            score += np.bincount(postings, np.concatenate([self.values[d, a:b] * query[d] for a, b, d in spans]), len(self.ids))
            lo, hi = np.where(rising, 0, taken), np.where(rising, last - taken, last)
            unseen = (self.segment >= lo) & (self.segment < hi)
            reach = np.where(rising, self.high[np.maximum(hi - 1, 0), range(dims)], self.low[np.minimum(lo, last - 1), range(dims)]) * query
            sure, possible = (score[:, None] + unseen.astype(np.float64) @ np.stack([least, reach], 1)).T
            floor = np.partition(sure[alive], n - k)[n - k]
            members = np.flatnonzero(alive & (possible >= floor - 1e-9 * abs(floor)))
            if len(members) <= max(4 * k, n // 16):  # proof: no other row reaches the k-th
                break
        return self._exact(members, query, k)

    def _exact(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.rows[rows] @ query
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best vectors; rows of the query's own id are no candidates."""
    found, asked = whole_numbers(vectors, key, column, scale), whole_numbers(queries, key, column, scale).distinct()
    n, m = found.count(), asked.count()
    blocks, parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // QUERY_ROWS))
    dim = F.size("v").alias("dim")
    left = found.select(dim, F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qb"), F.col("id").cast("long").alias("id"), "v")
    right = asked.select(dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("vb"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("qb"), F.col("id").cast("long").alias("id"), F.xxhash64("v").alias("tag"), "v")

    def cell(rows: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and own.num_rows:
            index = Index(rows["id"].to_numpy(), _matrix(rows["v"]))
            for qid, tag, q in zip(own["id"].to_pylist(), own["tag"].to_pylist(), _matrix(own["v"])):
                ids, scores = index.top(q, k, qid)
                out += [(qid, tag, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return pa.table({name: pa.array([r[i] for r in out], pa.int64()) for i, name in enumerate(("query_id", "tag", "vec_id", "score"))})

    cells = left.groupBy("dim", "vb", "qb").cogroup(right.groupBy("dim", "vb", "qb")).applyInArrow(cell, "query_id long, tag long, vec_id long, score long")
    best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return cells.select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

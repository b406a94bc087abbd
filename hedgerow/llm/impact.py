"""Operator 2: exact top-k inner products by an impact-ordered index, score at a time.

Components are made integers and quantised to at most ``IMPACTS`` impacts a dimension (where a shard's integers span
fewer values, an impact is one integer). The index of a shard holds for each dimension its posting segments: the vectors
of one impact each, in order of impact. A query turns a segment into a contribution, its weight times the impact's
upper end, and takes the segments of all dimensions in descending order of contribution, in rounds. A vector's
accumulator bounds what it has got; each dimension in which it hasn't been met can add no more than the largest
contribution that is left. The pass stops only where that bound proves that few vectors can be among the best; all of
these are rescored exactly, so the result is exact.

Vectors are dealt into shards, each indexed once (vectors.searched); queries alone are copied.

Defined results: see vectors.taking_part. Vectors meet queries of their own length only, of any length. Scores are exact
integers; one that doesn't fit a long is returned as the nearest long, and ties with others that do so. An empty table
gives no rows; fewer candidates than k are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import searched, taking_part

#: Impacts of a dimension.
IMPACTS = 1024
#: Contributions, in mean sizes of a query's contributions, at which a round ends.
ROUNDS = (0.6, 0.15, 0.0, -0.25, -0.7)
#: Vectors that are rescored first, to know a score that counts.
_FIRST = 64
#: A product of Euclidean lengths below which every sum of products is exact in 64 bits.
_EXACT = 2.0**62


class Index:
    """The posting segments of one shard of integer vectors (rows of int64), in ascending order of id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        span = max(int(rows.max(initial=0)) - int(rows.min(initial=0)), 0)
        self.shift = max(span.bit_length() - IMPACTS.bit_length() + 1, 0)
        self.width = (1 << self.shift) - 1  # from an impact's lower to its upper end
        impact = rows >> self.shift
        n, dims = rows.shape
        self.order = np.ascontiguousarray(np.argsort(impact, axis=0, kind="stable").T)
        low = np.take_along_axis(impact, self.order.T, axis=0).T << self.shift
        self.low = np.ascontiguousarray(low.astype(np.float64))
        # segments of all dimensions in a row: lower end, dimension, first posting; and each dimension's first segment
        first = np.ones(low.shape, bool)
        first[:, 1:] = low[:, 1:] != low[:, :-1]
        self.seg_dim, self.seg_at = np.nonzero(first)
        self.seg_low = self.low[self.seg_dim, self.seg_at]
        self.dim_first = np.searchsorted(self.seg_dim, np.arange(dims))
        self.dim_segs = np.bincount(self.seg_dim, minlength=dims)
        length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        self.norm = float(length.max(initial=0)) + self.width * float(np.sqrt(dims))
        self.size = np.sqrt((rows.astype(np.float64) ** 2).mean(axis=0)) if n else np.zeros(dims)

    def search(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors but the query's own."""
        n, weight = len(self.ids), q.astype(np.float64)
        if self.norm * float(np.sqrt((weight**2).sum())) >= _EXACT:
            return self._large(qid, q, k)
        up, used = weight > 0, weight != 0
        # what a vector in each segment can get at most; descending contributions begin at a dimension's end if q > 0
        gain = (self.seg_low + self.width * up[self.seg_dim]) * weight[self.seg_dim]
        total, met, taken = np.zeros(n), np.zeros(n, np.int64), np.zeros(len(q), np.int64)
        unit = float(np.sqrt(((weight * self.size) ** 2).mean())) if len(q) else 0.0
        flat_order, flat_low = self.order.reshape(-1), self.low.reshape(-1)
        least, may, dims = None, np.arange(n), int(used.sum())
        for theta in [r * unit for r in ROUNDS]:
            segs = np.add.reduceat((gain >= theta).astype(np.int64), self.dim_first) * used if n else taken
            edge = self.dim_first + np.where(up, self.dim_segs - segs, segs)
            inside = np.where(up, segs > 0, segs < self.dim_segs)
            bound = np.where(inside, self.seg_at[np.minimum(edge, len(self.seg_at) - 1)], n) if n else taken
            have = np.where(up, n - bound, bound) * used  # postings of each dimension
            new = np.flatnonzero(have > taken)
            if len(new):
                start = new * n + np.where(up, n - have, taken)[new]
                sizes = (have - taken)[new]
                taken = have
                parts = [slice(i, j) for i, j in zip(start.tolist(), (start + sizes).tolist(), strict=True)]
                where = np.concatenate([flat_order[part] for part in parts])
                got = np.concatenate([flat_low[part] for part in parts])
                if self.width:
                    got += np.repeat(self.width * up[new], sizes)
                got *= np.repeat(weight[new], sizes)
                total += np.bincount(where, got, n)
                met += np.bincount(where, minlength=n)
            if least is None:  # a first guess of the least score that counts
                near = np.argpartition(-total, min(_FIRST, n) - 1)[:_FIRST] if n else np.zeros(0, np.int64)
                others = (self.rows[near] @ q)[self.ids[near] != qid]
                if len(others) < k:
                    break  # few vectors at all
                least = int(np.partition(others, len(others) - k)[len(others) - k])
            most = total + (dims - met) * theta
            slack = 1 + 2.0**-45 * (abs(least) + float(np.abs(total).max()) + dims * (abs(theta) + float(np.abs(gain).max())))
            may = np.flatnonzero(most >= least - slack)
            if len(may) * 16 <= n:
                break
        may = may[self.ids[may] != qid]
        scores = self.rows[may] @ q
        if len(may) > 8 * k:
            near = np.partition(scores, len(scores) - k)[len(scores) - k]
            may, scores = may[scores >= near], scores[scores >= near]
        order = np.lexsort((self.ids[may], -scores))[:k]
        return self.ids[may][order], scores[order]

    def ask(self, qids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, ids, scores) of each query's best."""
        for qid, q in zip(qids.tolist(), queries, strict=True):
            ids, scores = self.search(qid, q, k)
            yield np.full(len(ids), qid), ids, scores

    def _large(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As search(), with integers of any size: every vector is rescored."""
        scores = self.rows.astype(object) @ q.astype(object)
        end = (1 << 63) - 1
        found = sorted((-max(min(int(s), end), -end - 1), int(i)) for i, s in zip(self.ids, scores, strict=True) if i != qid)[:k]
        return np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector with ``is_query`` (on vec_id) the k highest integer inner
    products with other vectors, ties to the smaller id."""
    part = taking_part(vectors).select("vec_id", F.transform("vec", lambda v: F.floor(v.cast("double") * scale)).alias("vec"))
    return searched(written(part, "integer-vectors"), is_query, k, Index, "long")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""

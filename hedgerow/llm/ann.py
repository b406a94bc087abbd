"""Operator 3: approximate nearest neighbours by cross-polytope hashing.

Vectors are dealt into shards of bounded size (vectors.searched), each indexed by ``TABLES`` hash tables. A table turns
vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and hashes them to the nearest
signed axis. A query probes, in each table, the axes nearest to it in turn; the vectors of all probed buckets of all
tables are its candidates, which are reranked exactly. A query that meets
fewer than k of a shard's vectors probes all its axes. Each shard's best are merged. Each vector is stored and moved
once, and in all tables of its shard; queries are copied, one for each shard.

A shard's size is bounded, so one polytope a table is enough at every size of the whole table: what grows with the input
is the number of shards, and recall doesn't depend on it. The number of probed axes is fitted, before the search, so that
``RECALL`` of the nearest neighbours in a bounded sample (``SAMPLE`` vectors and ``ASKED`` queries, the same at every
run) have a bucket in common with their query; the sample's neighbours at the same share of it as k has of all vectors
count. Neighbours in a small sample are farther away than those in the whole table, so the fit errs towards more probes.

Defined results: see vectors.taking_part; zero vectors take no part. Vectors meet queries of their own length only. An
empty table gives no rows; fewer candidates than k are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best, searched, taking_part

TABLES = 8
#: Share of near neighbours that the probes are fitted to find, and the sample that they are fitted on.
RECALL, SAMPLE, ASKED = 0.95, 4096, 512
#: Pairs of a query and a vector that are looked at together.
_PAIRS = 4 << 20


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """The rows of x, zero-padded to a power of two, under a table's pseudo-rotation (up to scale)."""
    n = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.concatenate([x, np.zeros((len(x), n - x.shape[1]))], axis=1)
    rng = np.random.default_rng([table, n])
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], n)
        h = 1
        while h < n:
            x = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
            h *= 2
    return x


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first (ties to the lower number)."""
    y = rotated(x, table)
    y = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return y.argmax(axis=1)[:, None]
    return np.argsort(-y, axis=1, kind="stable")[:, :probes]


def every_axis(dims: int) -> int:
    """The signed axes of vectors of so many components."""
    return 2 << max(1, int(dims - 1).bit_length())


def probes_for(sample: np.ndarray, count: int, k: int) -> int:
    """The probed axes at which RECALL of the sample's nearest neighbours are met, where ``count`` vectors are searched."""
    x = sample.astype(np.float64)
    asked = x[:ASKED]
    near = min(max(round(len(x) * k / max(count, 1)), 1), len(x) - 1)
    if near < 1:
        return 1
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    found = np.argpartition(-score, near - 1, axis=1)[:, :near]
    needed = np.full(found.shape, every_axis(x.shape[1]))
    for t in range(TABLES):
        order = axes(asked, t, every_axis(x.shape[1]))
        place = np.argsort(order, axis=1)
        own = axes(x, t, 1)[:, 0]
        needed = np.minimum(needed, np.take_along_axis(place, own[found], axis=1) + 1)
    return int(np.quantile(needed, RECALL, method="higher"))


class Tables:
    """The hash tables of one shard: for each table the vectors in order of their axis, and where each axis begins."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, probes: dict[int, int]) -> None:
        self.ids, self.x = ids, rows.astype(np.float64)
        dims = rows.shape[1]
        self.axes = every_axis(dims)
        self.probes = min(probes.get(dims, self.axes), self.axes)
        self.tables = []
        for t in range(TABLES):
            own = axes(self.x, t, 1)[:, 0]
            self.tables.append((np.argsort(own, kind="stable"), np.searchsorted(np.sort(own), np.arange(self.axes + 1))))

    def ask(self, qids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, ids, scores) of the nearest candidates of each query."""
        step = max(_PAIRS // max(len(self.ids), 1), 1)
        for i in range(0, len(qids), step):
            yield self._nearest(qids[i : i + step], queries[i : i + step].astype(np.float64), k)

    def _nearest(self, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates are scored roughly; those near the k-th again, alike wherever a vector stands, so that equals tie."""
        rough = np.full((len(qids), len(self.ids)), -np.inf)
        for t, (order, begin) in enumerate(self.tables):
            probed = axes(q, t, self.probes)
            who = np.repeat(np.arange(len(qids)), probed.shape[1])[np.argsort(probed, axis=None, kind="stable")]
            ends = np.searchsorted(np.sort(probed, axis=None), np.arange(self.axes + 1))
            for a in range(self.axes):
                bucket, asking = order[begin[a] : begin[a + 1]], who[ends[a] : ends[a + 1]]
                if len(bucket) and len(asking):
                    rough[asking[:, None], bucket] = q[asking] @ self.x[bucket].T
        rough[qids[:, None] == self.ids[None, :]] = -np.inf
        short = np.flatnonzero((rough > -np.inf).sum(axis=1) < k)  # these probe on, through every axis
        if len(short):
            rough[short] = np.where(qids[short][:, None] == self.ids[None, :], -np.inf, q[short] @ self.x.T)
        if len(self.ids) > k:
            least = np.partition(rough, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
        else:
            least = np.full(len(qids), -np.inf)
        slack = 1e-9 * (1 + np.abs(least))
        row, col = np.nonzero((rough >= np.where(np.isfinite(least), least - slack, least)[:, None]) & (rough > -np.inf))
        score = (q[row] * self.x[col]).sum(axis=1)
        return best(qids[row], self.ids[col], score, k)


def fitted(part: DataFrame, k: int) -> dict[int, int]:
    """The probes of each length of vectors, by a bounded sample of the most frequent lengths; other lengths have few
    vectors and probe every axis."""
    counts = part.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(8).collect()
    out = {}
    for dims, count in counts:
        rows = part.filter(F.size("vec") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec")
        out[dims] = probes_for(np.array([r.vec for r in rows.collect()], np.float64), count, k)
    return out


def neighbours(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found, by inner product, of each vector with ``is_query``."""
    part = written(taking_part(vectors, zero=False), "vectors")
    return searched(part, is_query, k, partial(Tables, probes=fitted(part, k)), "double")

"""What the two vector searches share: which vectors take part, shards past which queries stream, and the best hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches

#: Components of a shard: no more than the first; no fewer than the second only to give all cores a shard.
SHARD, SMALL_SHARD = 1 << 22, 1 << 19
#: Hits that are held before they are merged.
_HELD = 200_000

def taking_part(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """``(vec_id, vec)`` of vectors(vec_id, embedding): non-null, all components finite, not all zero unless ``zero``.

    Exact repeats count once; of different vectors under one id the least counts. Null ids take no part.
    """
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    if not zero:
        rows = rows.filter(F.exists("embedding", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("vec"))


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest score, then smallest id; a pair that is there twice counts once."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1]) | (score[1:] != score[:-1])
    query, vec, score = query[once], vec[once], score[once]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
    return query[rank < k], vec[rank < k], score[rank < k]


def _matrix(col: pa.ListArray) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _streamed(batches: Iterator[pa.RecordBatch], build: Callable, k: int) -> Iterator[pa.RecordBatch]:
    """The best hits of a partition's rows (dims, shard, asks, vec_id, vec), sorted by these: a shard's vectors come
    first, then its queries."""
    at: tuple | None = None
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    index = None
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in best(*[np.concatenate(x) for x in zip(*hits, strict=True)], k)], ["query_id", "vec_id", "score"])

    for b in batches:
        if not b.num_rows:
            continue
        dims, shard, asks, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            rows = _matrix(b.column(4).slice(i, j - i))
            if at != (dims[i], shard[i]):
                at, waiting, index = (dims[i], shard[i]), [], None
            if not asks[i]:
                waiting.append((ids[i:j], rows))
                continue
            if not waiting:
                continue
            if index is None:
                every = np.concatenate([w[0] for w in waiting])
                order = np.argsort(every, kind="stable")
                index = build(every[order], np.concatenate([w[1] for w in waiting])[order])
                waiting = waiting[:1]
            for found in index.ask(ids[i:j], rows, k):
                hits.append(found)
                held += len(found[0])
                if held > _HELD:
                    yield out()
                    hits, held = [], 0
    if held:
        yield out()


def searched(part: DataFrame, is_query: Column, k: int, build: Callable, score: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from a stored part(vec_id, vec): vectors are dealt into shards, each indexed
    once by ``build(ids, rows)`` in one task with bounded memory; queries alone are copied, one for each shard, and
    stream past the index's ``ask(ids, rows, k)``; only each shard's best are merged."""
    part = part.withColumn("dims", F.size("vec"))
    size = part.agg(F.sum("dims")).first()[0] or 0
    shards = max(-(-size // SHARD), min(-(-size // SMALL_SHARD), part.sparkSession.sparkContext.defaultParallelism), 1)
    own = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    columns = lambda rows, at, asks: rows.select("dims", at.alias("shard"), F.lit(asks).alias("asks"), "vec_id", "vec")
    dealt = columns(part, own, False).union(columns(part.filter(is_query), every, True))
    dealt = dealt.repartition(4 * shards, "dims", "shard").sortWithinPartitions("dims", "shard", "asks")
    return ranked(in_batches(dealt, lambda it: _streamed(it, build, k), f"query_id long, vec_id long, score {score}"), k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of hits(query_id, vec_id, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

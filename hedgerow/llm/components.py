"""Connected components of a graph given by its links between longs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, made, written


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): each node's least neighbour. Grouped under another form of the node, so that a join by node exchanges both
    its sides: only then does adaptive execution split the links of a node that has very many."""
    return edges.groupBy(F.bitwise_not("a").alias("node")).agg(F.min("b").alias("m")).select(F.bitwise_not("node").alias("a"), "m")


def _large(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; every link has a > b."""
    least = _least(edges)
    rest = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``, a <> b: root is the least node that it is linked to.

    Each round is written to the shared folder, so lost executors cost one round at most. Rounds grow with the
    logarithm of the longest chain. No links give no rows.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sums = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    spark, now = edges.sparkSession, sums(edges)
    while now[0]:
        last = made(spark)[-1:]
        edges = written(_small(_large(edges)), "links")
        delete(spark, last)
        before, now = now, sums(edges)
        if before == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())

"""Operator 9: mixes sources to target weights by hash-threshold histograms.

Sizes are summed by source and by bucket of a hash of the document id. Each source takes whole copies of itself, and
for the rest of its target every document under a hash threshold. The threshold is found by histograms: the bucket in
which the running sum passes the rest is the only one refined, by the hash's next bits, until single hashes are told
apart; then documents are filtered, not sorted. A larger rest has a higher threshold, so mixes are nested.

Targets: sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` times all sizes; a target
stops at ``MOST`` times its source's size, and what is over is shared again by weight until none is above. Only one row
for each source meets in one task.

Defined results: size is the number of words; null and empty texts have none. Rows with one doc_id share a hash, so
they are taken or left together. A null doc_id hashes as the empty text. Sources without words have target 0. An empty
table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the hash, and of them those that each level's histogram tells apart.
BITS, LEVEL = 48, 12
_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words of a text."""
    full = F.regexp_replace(text, rf"^{_GAP}|{_GAP}\z", "")
    return F.coalesce(F.when(full == "", 0).otherwise(F.size(F.split(full, _GAP, -1))), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """A document's hash: the first 48 bits of the MD5 of its id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from (source, source_size), one row for each source."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")).withColumn("budget", SHARE * F.sum("source_size").over(every))
    # sources fill up in the order of cap by weight; the level is what the others get for each unit of weight
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("order", F.row_number().over(by_fill)).withColumn("level", (F.col("budget") - before) / left)
    level = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("order"))).over(every)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def thresholds(docs: DataFrame, rests: DataFrame) -> DataFrame:
    """``(source_key, threshold)`` from docs(source_key, place, size) and rests(source_key, rest): documents under the
    threshold come as near to the rest as whole documents can (null: all are taken)."""
    state = rests.select("source_key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    up = Window.partitionBy("source_key").orderBy("bucket")
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        bucket = F.shiftright("place", shift)
        rows = docs.withColumn("bucket", bucket).join(state, "source_key").filter(F.shiftright("bucket", LEVEL) == F.col("prefix"))
        sums = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        sums = sums.withColumn("until", F.col("before") + F.sum("sum").over(up))
        if shift:
            first = F.min_by(F.struct("rest", F.col("bucket").alias("prefix"), (F.col("until") - F.col("sum")).alias("before")), "bucket")
            state = sums.filter(F.col("until") > F.col("rest")).groupBy("source_key").agg(first.alias("x")).select("source_key", "x.*")
    # single hashes: one is taken if that brings the sum nearer to the rest; all of the last bucket may be
    out = F.min(F.when(F.col("until") - F.col("sum") / 2 > F.col("rest"), F.col("bucket")))
    state = sums.groupBy("source_key").agg(F.coalesce(out, F.max("bucket") + 1).alias("prefix"))
    return rests.select("source_key").join(state, "source_key", "left").select("source_key", F.col("prefix").alias("threshold"))


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))


def plan(sizes: DataFrame) -> DataFrame:
    """One row for each source of sizes(doc_id, source, size): source_size, target, whole copies and the threshold under
    which documents are taken once more. ``sizes`` is read more than once, so it should be a stored table."""
    by_source = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)
    found = targets(by_source).withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("source_key", _key())
    found = written(found, "mix-plan")
    placed = sizes.filter("size > 0").groupBy(_key().alias("source_key"), place(F.col("doc_id")).alias("place")).agg(F.sum("size").alias("size"))
    found = found.join(thresholds(written(placed, "mix-places"), found), "source_key").select(F.col("source_key").alias("hedgerow_key"), "source_size", "target", "whole", "threshold")
    # stored, so that its size is known: where it is small Spark sends it to the documents, else it shuffles both
    return written(found, "mix-thresholds")


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(doc_id, source, size, ...) with source_size, target and copies (how often the mix takes the row)."""
    base = rows.drop("source_size", "target", "copies", "whole", "threshold").withColumn("hedgerow_key", _key())
    # a source at its cap takes whole copies alone: no document exceeds MOST times itself, one without words neither
    room = F.col("whole") < MOST
    extra = F.when(room & (F.col("threshold").isNull() | (place(F.col("doc_id")) < F.col("threshold"))), 1).otherwise(0)
    return base.join(plan, "hedgerow_key").withColumn("copies", F.col("whole") + extra).drop("hedgerow_key", "whole", "threshold")


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target and copies."""
    return taken(docs.withColumn("size", words(F.col("text"))), plan(written(sized(docs), "sizes")))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget FROM s),
f AS (SELECT *, row_number() OVER o AS n, (budget::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT f.*, least(cap::DOUBLE, coalesce((SELECT arg_min(level, n) FROM f g WHERE g.level * g.weight <= g.cap) * weight, cap::DOUBLE)) AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until, sum(d.size) OVER (PARTITION BY d.source, d.place) AS own
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN until - own / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""

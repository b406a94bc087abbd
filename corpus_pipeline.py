"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
driver writes each stage's rows as Parquet and reads them again as the next one's docs; ``run`` does the same through
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.llm import bpe, lines, mixing, similar, toxicity
from hedgerow.llm.common import delete, made, ship, table, written
from hedgerow.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    ship(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of lines go; every document stays."""
    ship(spark)
    kept = lines.dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNull(), None).otherwise(F.col("kept"))
    return kept.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (by SimHash blocks and the exact share, 0.8 of five-word shingles; see similar) one document stays, that with the smallest doc_id (of
    several texts under it, that with the least hash); rows without a doc_id all stay."""
    ship(spark)
    rows = docs.select(*COLUMNS)
    groups = similar.near_copies(rows).filter("doc_id = component_id")
    kept = groups.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"))
    rest = F.struct(*COLUMNS[1:])
    keyed = rows.filter("doc_id is not null").select("doc_id", similar.row_key(F.col("text")).alias("row"), rest.alias("rest"))
    one = keyed.join(kept, ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.min("rest").alias("rest"))
    return one.select("doc_id", "rest.*").select(*COLUMNS).unionByName(rows.filter("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: left out, once or twice."""
    ship(spark)
    rows = mixing.mix(docs.select(*COLUMNS))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    ship(spark)
    return bpe.encode_decode_digest(docs, vocabulary())


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", repeated_lines_out),
    ("near-duplicates", one_of_near_duplicates),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: A trained model decides the first stage, so SQL can't express the rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    read = None
    for name, stage in STAGES[:-1]:
        before = list(made(spark))
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # what the stage wrote, but for its rows, and the rows that it read
        delete(spark, [p for p in made(spark)[:-1] if p not in before or p == read])
        read = made(spark)[-1]
    return STAGES[-1][1](spark, docs, sf_dir)

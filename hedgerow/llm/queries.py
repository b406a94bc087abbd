"""The thin opN queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, impact, lines, mixing, pii, simhash, substrings, tokens, toxicity
from .common import scratch_path, table, until_exit, written


def vocabulary() -> str:
    """The file of the public byte-level tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents"), path, vocabulary())
    until_exit(spark, path)
    stored = tokens.read(spark, path)
    found = tokens.with_start(tokens.checksums(stored), stored)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_crosspolytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digest(table(spark, sf_dir, "documents"), vocabulary())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(mixing.sized(table(spark, sf_dir, "documents")), "sizes")
    found = mixing.taken(sizes, mixing.plan(sizes))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_orc_tokens": op1_orc_tokens,
        "op2_impact_topk": op2_impact_topk,
        "op3_crosspolytope_ann": op3_crosspolytope_ann,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_bpe": op6_bpe,
        "op7_pii": op7_pii,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_mix_sources": op9_mix_sources,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_impact_topk": impact.ORACLE_SQL,
        "op5_line_dedup": lines.oracle_sql(),
        "op7_pii": pii.oracle_sql(),
        "op8_substring_dedup": substrings.oracle_sql(),
        "op9_mix_sources": mixing.ORACLE_SQL,
    }

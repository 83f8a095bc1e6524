"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.sources.tables import read_table

from . import distinctive, generated, lookalike, near_dup, packing, splitting, tokens


def _records(spark: SparkSession, d: str) -> DataFrame:
    """kind, id, text of the chunks and the files."""
    chunks = read_table(spark, d, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_key").alias("id"), "text")
    return chunks.unionByName(read_table(spark, d, "repo_files").select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "text"))


def p1_token_totals(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(read_table(spark, d, "repo_files"), read_table(spark, d, "repos"), read_table(spark, d, "documents"))


def p1_file_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.file_tokens(read_table(spark, d, "repo_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = near_dup.similarity_join(_records(spark, d), k=3, threshold=0.6, min_shingles=40)
    return near_dup.record_pairs(links, members)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_groups(_records(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.forced_cuts(read_table(spark, d, "repo_files"), read_table(spark, d, "split_limits"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_files(read_table(spark, d, "repo_files"), read_table(spark, d, "split_limits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.not_handwritten(read_table(spark, d, "repo_files"))


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return generated.kinds(read_table(spark, d, "repo_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.leading_terms(read_table(spark, d, "chunks"), read_table(spark, d, "term_probes"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.score_terms(read_table(spark, d, "chunks")).withColumn("score", F.round("score", 6))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(read_table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, d, "documents"), read_table(spark, d, "context_windows"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_checks(read_table(spark, d, "documents"), read_table(spark, d, "context_windows"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_fill(p7_containers(spark, d)).withColumn("unused_pct", F.round("unused_pct", 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(read_table(spark, d, "documents"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(read_table(spark, d, "documents"))


def queries() -> dict:
    own = (p1_token_totals, p1_file_tokens, p2_found, p2_groups, p3_found, p3_pieces, p4_found, p4_kinds, p5_found, p5_terms, p6_ids, p7_containers, p7_checks, p7_fill, p8_found, p8_canonical)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)

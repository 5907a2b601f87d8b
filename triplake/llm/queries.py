"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplake.llm import decontam, extraction, language, lines, minhash, mixing, phrases, quality, sharding, sql, suffix_tree, tokens, vectors, warc
from triplake.llm.shared import table, written


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_benchmark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.fails("base-1").alias("base_failed"), (~quality.fails("full-1")).alias("kept"), "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7's ablation: what each rule of each policy rejects, alone and with others, over all documents."""
    held = written(quality.ledger(table(spark, sf_dir, "documents").select("text")).select("fail_bits"), "ledger")
    policies = [quality.ablation(held, p).withColumn("policy", F.lit(p)) for p in quality.POLICIES]
    return reduce(DataFrame.unionByName, policies)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return suffix_tree.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out)


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.code_table(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_centroid_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return language.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), held_out)


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minimax_shards, op2_benchmark_tiles, op3_line_chunks, op4_minhash_duplicates, op5_warc_bundles, op6_source_mix, op7_quality_ledger, quality_ablation, op8_main_text, op9_token_counts, op10_suffix_tree_scores, op11_ball_codes, op12_centroid_languages, op13_phrase_automata)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)

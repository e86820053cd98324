"""The thin queries over the operators, one each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, linededup, mixing, packing, quality, repeats, simhash, sketch, tokencount, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_and_next(_documents(spark, sf_dir))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.draws(mixing.sized(_documents(spark, sf_dir)))
    taken = (F.size("copies") * F.col("size")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken, F.transform("copies", lambda c: c["shard"]).alias("shards"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op10_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_scaled_sketch": op2_scaled_sketch,
        "op3_warc_revisits": op3_warc_revisits,
        "op4_language_id": op4_language_id,
        "op5_line_dedup": op5_line_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_source_mixing": op8_source_mixing,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_repeat_removal": op10_repeat_removal,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.oracle_sql()}

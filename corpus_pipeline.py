"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. quality rules: rejected documents go;
2. line dedup: lines that occur earlier, equal or nearly so, go from the texts;
3. SimHash near-dedup: one document of each group stays;
4. mixing: documents are repeated or left out until sources have their target weights, and written by output shard;
5. packing: pieces of the mixed documents with their sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import linededup, mixing, packing, quality, simhash
from millrace.llm.contract import tokenizer_path
from millrace.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.by_shard(mixing.mix(docs)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints, the draws and the tokenizer are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

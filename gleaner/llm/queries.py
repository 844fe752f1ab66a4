"""Registered queries of this subpackage: name -> (spark, folder of the tables) -> result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gleaner.llm import (
    bpe,
    collocations,
    conversation_repair,
    decontamination,
    html_text,
    minhash_forest,
    ngram_jaccard,
    quality_rules,
    sharding,
    suffix_dedup,
    url_filters,
    warc,
)
from gleaner.llm.storage import prepared
from gleaner.llm.substring_dedup import ORACLE as substring_dedup_sql
from gleaner.llm.substring_dedup import digests as substring_digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_warc_normaliser", warc.ORACLE)
def warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


@query("op2_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.classes(table(spark, folder, "documents"))


@query("op5_substring_dedup", substring_dedup_sql)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_digests(table(spark, folder, "documents"))


@query("op6_quality_rules", quality_rules.ORACLE)
def quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, folder, "documents")).drop("text_key")


@query("op9_benchmark_decontamination", decontamination.ORACLE)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_bpe_encoding_and_decoding")
def bpe_encoding_and_decoding(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), corpus_pipeline.tokenizer_path())


@query("op4_url_filters", url_filters.ORACLE)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judged(table(spark, folder, "pages"))


@query("op10_sharding")
def document_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(prepared(spark), folder)


@query("op7_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents"))


@query("op8_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


@query("op11_minhash_near_dedup", minhash_forest.ORACLE)
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, folder, "documents"))


@query("op12_conversation_structure_repair", conversation_repair.ORACLE)
def conversation_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return conversation_repair.judged(conversation_repair.damaged(conversations), conversations)


@query("op13_phrase_collocation_mining", collocations.ORACLE)
def phrase_collocation_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))

"""Typed reads and writes of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "topics": "topic_id bigint, name string, slug string, category string",
    "topic_aliases": "topic_id bigint, alias string, weight decimal(3,2)",
    "sources": (
        "source_id string, name string, source_type string, feed_url string, site_url string, is_active boolean, "
        "fetch_interval_minutes int, last_fetched_at timestamp, last_success_at timestamp, last_error string, "
        "max_article_age_days int, trust_tier string, discovery_query string, min_engagement int"
    ),
    "source_topics": "source_id string, topic_id bigint",
    "content_items": (
        "id string, source_id string, external_id string, canonical_url string, url_hash string, title string, "
        "summary string, body_content string, author string, image_url string, published_at timestamp, "
        "fetched_at timestamp, is_hidden boolean, backfilled_at timestamp, word_count int, dedupe_key string"
    ),
    "content_item_topics": "item_id string, topic_id bigint",
    "content_item_signals": (
        "item_id string, engagement_count bigint, source_count int, platform string, collected_at timestamp"
    ),
    "discovery_candidates": (
        "url_hash string, canonical_url string, title string, source_id string, topic_id bigint, score decimal(4,3), "
        "decision string, reason string, signals struct<relevance:double,trust:double,substance:double,"
        "engagement:double,freshness:double>, created_at timestamp"
    ),
    "user_topics": "user_id bigint, topic_id bigint",
    "saved_items": "user_id bigint, item_id string, is_read boolean, saved_at timestamp",
    "user_submissions": "submission_id bigint, user_id bigint, submitted_url string, item_id string, status string",
    "ingestion_runs": (
        "run_id string, source_id string, started_at timestamp, completed_at timestamp, status string, "
        "items_seen int, items_inserted int, items_updated int, items_skipped int, error_count int, error_message string"
    ),
    "discovery_quota": "platform string, window_started_at timestamp, used int",
}

# What an enumerated column may hold.
ALLOWED = {
    ("topics", "category"): ["company", "tool", "framework", "platform", "concept"],
    ("sources", "trust_tier"): ["official", "community", "probationary", "unknown"],
    ("discovery_candidates", "decision"): ["accepted", "rejected"],
    ("user_submissions", "status"): ["queued", "processing", "completed", "failed"],
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Stored tables by name, each with its declared schema."""
    return {name: spark.read.schema(schema_of(name)).parquet(f"{folder}/{name}") for name in names or list(SCHEMAS)}


def valid_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows whose enumerated columns hold an allowed value or none."""
    for (table, column), allowed in ALLOWED.items():
        if table == name and column in df.columns:
            df = df.filter(df[column].isNull() | df[column].isin(allowed))
    return df


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


TEXT_TABLES = ["documents", "pages"]


def read_driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given parquet tables, with zone-less times read as UTC.

    Text work is heavy per byte, so a text table in fewer splits than there are
    cores is spread out; a table of many files is read as it is.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    naive = [field.name for field in df.schema if isinstance(field.dataType, T.TimestampNTZType)]
    return df.withColumns({column: df[column].cast("timestamp") for column in naive})

"""Link keys: canonicalise, match and merge rows that are the same article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import links


def canonicalize_links(df: DataFrame, url_col: str) -> DataFrame:
    """Adds canonical_url, url_hash and error; bad links keep their row with a reason."""
    url = F.col(url_col)
    keyed = df.withColumn("error", links.link_error(url)).withColumn("canonical_url", links.canonical_url(url))
    return keyed.withColumn("url_hash", links.url_hash(F.col("canonical_url")))


def with_dedupe_key(df: DataFrame, url_col: str = "canonical_url") -> DataFrame:
    return df.withColumn("dedupe_key", links.dedupe_key(F.col(url_col)))


def completeness() -> Column:
    """An image is worth two, a body one."""
    return F.when(F.col("image_url").isNotNull(), 2).otherwise(0) + F.when(F.col("body_content").isNotNull(), 1).otherwise(0)


def _keepers(df: DataFrame, key: str) -> DataFrame:
    """Keeper per key by a map-side combined minimum, so a hot key is never gathered."""
    order = F.struct((-completeness()).alias("rank"), F.col("fetched_at"), F.col("id"))
    return df.groupBy(key).agg(F.min(order)["id"].alias("keep_id"))


def exact_duplicate_map(items: DataFrame) -> DataFrame:
    """id, dedupe_key, keep_id for every stored row."""
    narrow = with_dedupe_key(items).select("id", "dedupe_key", "image_url", "body_content", "fetched_at")
    return narrow.select("id", "dedupe_key").join(_keepers(narrow, "dedupe_key"), "dedupe_key")


def merge_exact_duplicates(items: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surviving items, and saves pointing at survivors (one per reader and item)."""
    mapping = exact_duplicate_map(items)
    survivors = items.join(mapping.filter("id = keep_id").select("id", "dedupe_key"), "id")
    moved = saved.join(mapping.withColumnRenamed("id", "item_id"), "item_id", "left").select(
        "user_id",
        F.coalesce("keep_id", "item_id").alias("target"),
        F.coalesce(F.col("keep_id") != F.col("item_id"), F.lit(False)).alias("was_moved"),
        "item_id",
        "is_read",
        "saved_at",
    )
    order = F.struct("was_moved", "saved_at", "item_id")
    kept = moved.groupBy("user_id", "target").agg(
        F.min_by("is_read", order).alias("is_read"), F.min_by("saved_at", order).alias("saved_at")
    )
    return survivors, kept.withColumnRenamed("target", "item_id")


def recanonicalize_plan(items: DataFrame) -> DataFrame:
    """What re-applying today's link rules would do to each stored row."""
    narrow = items.select("id", F.col("canonical_url").alias("stored_url"), F.col("url_hash").alias("stored_hash"),
                          "image_url", "body_content", "fetched_at")
    keyed = canonicalize_links(narrow, "stored_url")
    keepers = _keepers(keyed.filter(F.col("url_hash").isNotNull()), "url_hash")
    action = (
        F.when(F.col("url_hash").isNull(), "unparseable")
        .when(F.col("keep_id") != F.col("id"), "merged")
        .when(F.col("url_hash") == F.col("stored_hash"), "unchanged")
        .otherwise("rewritten")
    )
    return keyed.join(keepers, "url_hash", "left").select("id", "canonical_url", "url_hash", "keep_id", action.alias("action"))


def match_existing(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Adds existing_id and existing_source_id: match by hash first, then by key.

    The stored corpus is only filtered by what the candidates ask for; the few hits
    are grouped.
    """
    stored = with_dedupe_key(items).select("id", "source_id", "url_hash", "dedupe_key")
    first = F.min(F.struct("id", "source_id"))
    hashes = candidates.select("url_hash").distinct()
    links = candidates.select(F.col("canonical_url").alias("dedupe_key")).distinct()
    by_hash = stored.join(hashes, "url_hash", "left_semi").groupBy("url_hash").agg(first.alias("by_hash"))
    by_key = stored.join(links, "dedupe_key", "left_semi").groupBy("dedupe_key").agg(first.alias("by_key"))
    found = F.coalesce("by_hash", "by_key")
    return (
        candidates.join(by_hash, "url_hash", "left")
        .join(by_key, F.col("canonical_url") == F.col("dedupe_key"), "left")
        .withColumn("existing_id", found["id"])
        .withColumn("existing_source_id", found["source_id"])
        .drop("by_hash", "by_key", "dedupe_key")
    )


def word_counts(items: DataFrame, body_col: str = "body_content") -> DataFrame:
    """Adds word_count (null for a blank body) and reading_minutes."""
    body = F.trim(F.col(body_col))
    counted = items.withColumn("word_count", F.when(body != "", F.regexp_count(body, F.lit(r"\S+"))))
    minutes = F.greatest(F.lit(1), F.floor(F.col("word_count") / 200 + F.lit(0.5)).cast("int"))
    return counted.withColumn("reading_minutes", F.when(F.col("word_count") > 0, minutes))


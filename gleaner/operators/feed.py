"""Feed assembly: eligibility, cards, library, search and pages for every reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.links import host_of
from gleaner.functions.text import is_real_author
from gleaner.operators.keys import word_counts

# Days each view reaches back, page size, longest query.
WINDOW_DAYS = {"for-you": 3, "trending": 365, "latest": 365}
SEARCH_WINDOW_DAYS = 365
PAGE_SIZE = 50
QUERY_CHARS = 120

# Texts a card shows when the source gave none.
DEFAULT_EXCERPT = "Open the original source to read this story."
PLAIN_REASON = "Technology source"
TRACKED_REASON = "From a tracked source"
TIERS = ["official", "community", "probationary", "unknown"]


def window_days(view: str, query: str = "") -> int:
    return max(WINDOW_DAYS[view], SEARCH_WINDOW_DAYS) if query.strip() else WINDOW_DAYS[view]


def completed(submissions: DataFrame) -> DataFrame:
    return submissions.filter((F.col("status") == "completed") & F.col("item_id").isNotNull())


def saved_library(saved: DataFrame, submissions: DataFrame, tab: str) -> DataFrame:
    """A reader's saves: ``links`` they submitted themselves, or ``posts`` they did not."""
    own = completed(submissions).select("user_id", "item_id").distinct()
    how = "left_semi" if tab == "links" else "left_anti"
    return saved.join(own, ["user_id", "item_id"], how)


def feed_cards(
    items: DataFrame, sources: DataFrame, item_topics: DataFrame, signals: DataFrame, carry: list[str] | None = None
) -> DataFrame:
    """What a card shows, per item and independent of the reader; topics in topic order.

    A stored word_count is used as it is, so that no body is read. ``carry`` names further
    columns of the items to keep.
    """
    carry = carry or []
    linked = item_topics.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_set("topic_id")).alias("topics"))
    named = sources.select("source_id", F.col("name").alias("source_name"), "trust_tier")
    counted = signals.select(F.col("item_id").alias("id"), "engagement_count", "source_count")
    tier = F.when(F.col("trust_tier").isin(TIERS), F.col("trust_tier")).otherwise("official")
    counted_items = items if "word_count" in items.columns else word_counts(items)
    base = counted_items.select(
        "id", "source_id", "title", "summary", "canonical_url", "author", "published_at", "image_url", "word_count", *carry
    )
    return (
        base.join(named, "source_id", "left")
        .join(linked, "id", "left")
        .join(counted, "id", "left")
        .select(
            "id",
            "title",
            F.coalesce("summary", F.lit(DEFAULT_EXCERPT)).alias("excerpt"),
            F.col("canonical_url").alias("url"),
            F.coalesce("source_name", host_of(F.col("canonical_url"))).alias("source"),
            tier.alias("trust"),
            F.when(is_real_author(F.col("author")), F.col("author")).alias("author"),
            "published_at",
            "image_url",
            F.coalesce("engagement_count", F.lit(0)).alias("engagement_count"),
            F.coalesce("source_count", F.lit(1)).alias("source_count"),
            "word_count",
            F.coalesce("topics", F.array().cast("array<bigint>")).alias("topics"),
            *carry,
        )
    )


def explanation(topics: Column, names: Column) -> Column:
    """Reasons under a card; ``names`` maps topic ids to topic names."""
    first = F.when(F.size(topics) > 0, F.try_element_at(names, topics[0]))
    lead = F.when(first.isNotNull(), F.concat(F.lit("Matches "), first)).otherwise(PLAIN_REASON)
    return F.array(lead, F.lit(TRACKED_REASON))


def topic_names(topics: DataFrame) -> Column:
    return topics.agg(F.map_from_entries(F.collect_list(F.struct("topic_id", "name")))).scalar()


def readers(user_topics: DataFrame, affinity: DataFrame | None = None) -> DataFrame:
    """user_id, followed topics and learned affinity per topic (empty when none is given)."""
    followed = user_topics.groupBy("user_id").agg(F.array_sort(F.collect_set("topic_id")).alias("followed"))
    nothing = F.create_map().cast("map<bigint,double>")
    if affinity is None:
        return followed.withColumn("affinity_by_topic", nothing)
    learned = affinity.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("topic_id", "affinity"))).alias("affinity_by_topic")
    )
    return followed.join(learned, "user_id", "left").withColumn("affinity_by_topic", F.coalesce("affinity_by_topic", nothing))


def search_matches(query: str) -> Column:
    wanted = query.strip()[:QUERY_CHARS].lower()
    shown = F.concat_ws(" ", "title", "excerpt", F.coalesce("author", F.lit("")), "source")
    return F.contains(F.lower(shown), F.lit(wanted))


def search_feed(cards: DataFrame, query: str) -> DataFrame:
    """Cards whose visible text contains the query, ignoring case; an empty query keeps all."""
    return cards.filter(search_matches(query)) if query.strip() else cards

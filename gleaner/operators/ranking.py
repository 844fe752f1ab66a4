"""Feed scores and ranks for all readers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.scoring import clamp01, exploration, recency
from gleaner.session import settled

# Weights of the For You and Trending scores.
FOR_YOU = {"affinity": 0.38, "interest": 0.22, "recency": 0.2, "engagement": 0.12, "diversity": 0.06, "exploration": 0.02}
TRENDING = {"recency": 0.4, "engagement": 0.35, "diversity": 0.15, "breadth": 0.1}

# What a source tier multiplies the finished score by.
TRUST_MULTIPLIER = {"official": 1.0, "community": 0.85, "probationary": 0.7, "unknown": 0.6}

# Affinity range, and counts that saturate a term.
AFFINITY_SHIFT, AFFINITY_SPAN = 5.0, 25.0
FULL_ENGAGEMENT_DIGITS, FULL_SOURCES, FULL_TOPICS = 5.0, 5.0, 3.0

# Scores are compared at this many decimals, so that the last bit of a sum cannot reorder equals.
SCORE_DECIMALS = 12


def trust_multiplier(trust: Column) -> Column:
    result = F.lit(TRUST_MULTIPLIER["official"])
    for tier, factor in TRUST_MULTIPLIER.items():
        result = F.when(trust == tier, factor).otherwise(result)
    return result


def item_terms(items: DataFrame, now: Column) -> DataFrame:
    """Terms that do not depend on the reader; computed once per item."""
    return (
        items.withColumn("recency", recency(F.col("published_at"), now))
        .withColumn("engagement", clamp01(F.log10(F.coalesce("engagement_count", F.lit(0)) + F.lit(1.0)) / FULL_ENGAGEMENT_DIGITS))
        .withColumn("diversity", F.least(F.col("source_count") / FULL_SOURCES, F.lit(1.0)))
        .withColumn("exploration", exploration(F.col("id")))
        .withColumn("breadth", F.least(F.size("topics") / FULL_TOPICS, F.lit(1.0)))
        .withColumn("trust_factor", trust_multiplier(F.col("trust")))
        .withColumn("trending_score", trending_score())
    )


def interest_share(topics: Column, followed: Column) -> Column:
    return F.when(
        (F.size(topics) > 0) & (F.size(followed) > 0), F.size(F.array_intersect(topics, followed)) / F.size(topics)
    ).otherwise(F.lit(0.0))


def affinity_mean(topics: Column, affinity: Column) -> Column:
    """Mean over the item's topics; a topic without a learned value counts as 0."""
    total = F.aggregate(
        topics,
        F.lit(0.0),
        lambda acc, topic: acc
        + clamp01((F.coalesce(F.try_element_at(affinity, topic), F.lit(0.0)) + AFFINITY_SHIFT) / AFFINITY_SPAN),
    )
    return F.when(F.size(topics) > 0, total / F.size(topics)).otherwise(F.lit(0.0))


def for_you_score() -> Column:
    total = F.lit(0.0)
    for term, weight in FOR_YOU.items():
        total = total + F.col(term) * F.lit(weight)
    return F.round(total * F.col("trust_factor"), SCORE_DECIMALS)


def trending_score() -> Column:
    total = F.lit(0.0)
    for term, weight in TRENDING.items():
        total = total + F.col(term) * F.lit(weight)
    score = F.round(total * F.col("trust_factor"), SCORE_DECIMALS)
    return F.when(F.col("published_at").isNotNull(), score).otherwise(F.lit(-1.0))


def feed_scores(pairs: DataFrame) -> DataFrame:
    """Adds interest, affinity and the For You score to (reader, item) rows with item terms."""
    return (
        pairs.withColumn("interest", interest_share(F.col("topics"), F.col("followed")))
        .withColumn("affinity", affinity_mean(F.col("topics"), F.col("affinity_by_topic")))
        .withColumn("for_you_score", for_you_score())
    )


# What each view sorts by; everything else stays behind while rows are ranked.
VIEW_COLUMN = {"for-you": "for_you_score", "trending": "trending_score", "latest": "published_at"}


def view_order(view: str) -> list[Column]:
    if view == "for-you":
        return [F.col("for_you_score").desc(), F.col("id").asc()]
    if view == "trending":
        return [F.col("trending_score").desc(), F.col("id").asc()]
    return [F.col("published_at").desc_nulls_last(), F.col("id").asc()]


def positions(df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """row_number() per group without gathering a group in one task.

    Rows are range-partitioned on (group, order), so a hot group spans many
    tasks; a row's position is its place in its partition plus the sizes of the
    group's earlier partitions. Rows are checkpointed before the ranges are
    sampled, so that their plan runs once, and after the sort, which fixes the
    ranges even if an executor is lost. Pass narrow rows.
    """
    keys = [F.col(group).asc(), *order]
    df = settled(df)
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    ranged = settled(ranged)
    runs = ranged.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    place = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return ranged.join(runs, [group, "_part"]).withColumn(name, place).drop("_part", "_row", "_first", "_size", "_before")


def viewed(scored: DataFrame, view: str) -> DataFrame:
    """The narrow rows a view ranks; Trending lists dated items only."""
    listed = scored.filter(F.col("published_at").isNotNull()) if view == "trending" else scored
    return listed.select("user_id", "id", VIEW_COLUMN[view])


def rank_view(scored: DataFrame, view: str) -> DataFrame:
    """Full ranking of every reader's list."""
    return positions(viewed(scored, view), "user_id", view_order(view))


def rank_for_you(scored: DataFrame) -> DataFrame:
    return rank_view(scored, "for-you")


def rank_trending(scored: DataFrame) -> DataFrame:
    return rank_view(scored, "trending")


def rank_latest(scored: DataFrame) -> DataFrame:
    return rank_view(scored, "latest")


def top_of_view(listed: DataFrame, view: str, depth: int) -> DataFrame:
    """First ``depth`` rows per reader of :func:`viewed` rows; each task keeps only that many before the shuffle."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*view_order(view)))
    return listed.withColumn("position", place).filter(F.col("position") <= depth)

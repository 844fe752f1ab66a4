"""Folds and corrections of stateful tables, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scoring import iff
from gleaner.operators.skew import with_last

# Source kinds, default fetch interval, age of a dead run.
FEED_TYPES = ["rss", "atom", "medium_rss", "api", "web", "platform"]
DISCOVERY_TYPES = ["hacker_news", "dev_to", "stack_exchange", "github_releases", "youtube"]
DEFAULT_INTERVAL_MINUTES = 30
STALE_RUN_MINUTES = 30
MICROS_PER_MINUTE = 60_000_000

# What a reader event may be.
EVENT_TYPES = ["impression", "open", "save", "unsave", "mark_read", "mark_unread", "complete", "dismiss"]
MAX_DWELL_SECONDS = 86_400


SIGNALS = "struct<relevance:double,trust:double,substance:double,engagement:double,freshness:double>"


def verdict_rows(verdicts: DataFrame) -> DataFrame:
    """Verdicts in the shape of the log; topic_id and breakdown are null where a verdict has none."""
    for name, kind in (("topic_id", "bigint"), ("breakdown", SIGNALS)):
        if name not in verdicts.columns:
            verdicts = verdicts.withColumn(name, F.lit(None).cast(kind))
    return verdicts.select(
        "url_hash",
        "canonical_url",
        "title",
        "source_id",
        "topic_id",
        F.round("score", 3).cast("decimal(4,3)").alias("score"),
        F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("decision"),
        "reason",
        F.col("breakdown").cast(SIGNALS).alias("signals"),
        "created_at",
        F.to_date("created_at").alias("day"),
    )


def verdict_log(verdicts: DataFrame) -> DataFrame:
    """At most one verdict per link and UTC day; the first one wins."""
    rows = verdict_rows(verdicts)
    rest = [name for name in rows.columns if name not in ("url_hash", "day")]
    first = F.min_by(F.struct(*rest), F.struct("created_at", "canonical_url", "title", "reason")).alias("first")
    return rows.groupBy("url_hash", "day").agg(first).select("url_hash", "day", "first.*")


def hit_summaries(hits: DataFrame) -> DataFrame:
    """One summary per item of hits (item_id, hit_id, seen_at, platform, reported, stored_source_id, source_id).

    A summary has the most engagement, the first and last hit, and whether a hit
    came from another source right after another platform's. Looking back goes over
    ranges of hits, so an item, or an hour of it, that has all hits is many tasks; the
    rest are map-side combined aggregates.
    """
    told = hits.filter(F.col("reported").isNotNull()).select(
        "item_id", "seen_at", "hit_id", "platform", "reported", iff(F.col("stored_source_id") != F.col("source_id")).alias("other")
    )
    told = told.withColumn("place", F.struct("platform"))  # a hit without a platform is a hit all the same
    told = with_last(told, "item_id", [F.col("seen_at").asc(), F.col("hit_id").asc()], "place", "before")
    order = F.struct("seen_at", "hit_id")
    return told.groupBy("item_id").agg(
        F.max(F.greatest(F.lit(0), F.floor("reported"))).alias("engagement_count"),
        F.bool_or(iff(F.col("other") & (F.col("before.platform") != F.col("platform")))).alias("independent"),
        F.min_by(F.struct("platform", "other"), order).alias("first"),
        F.max_by(F.struct("platform", "seen_at"), order).alias("last"),
    )


def merge_hit_summaries(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Summaries of two consecutive stretches of hits as one."""
    e, n = earlier.alias("e"), later.alias("n")
    at_edge = iff(F.col("n.first.other") & (F.col("e.last.platform") != F.col("n.first.platform")))
    return e.join(n, F.col("e.item_id") == F.col("n.item_id"), "full_outer").select(
        F.coalesce("e.item_id", "n.item_id").alias("item_id"),
        F.greatest("e.engagement_count", "n.engagement_count").alias("engagement_count"),
        (iff(F.col("e.independent")) | iff(F.col("n.independent")) | at_edge).alias("independent"),
        F.coalesce("e.first", "n.first").alias("first"),
        F.coalesce("n.last", "e.last").alias("last"),
    )


def signals_of(summaries: DataFrame) -> DataFrame:
    """Stored signals: the very first hit has no platform before it, so it counts as another one."""
    second = F.col("independent") | F.col("first.other")
    return summaries.select(
        "item_id",
        "engagement_count",
        F.when(second, 2).otherwise(1).alias("source_count"),
        F.col("last.platform").alias("platform"),
        F.col("last.seen_at").alias("collected_at"),
    )


def signals_fold(hits: DataFrame) -> DataFrame:
    """Running signals per item; counts are never lowered, the last platform is kept.

    A second source counts only when another source stored the item and the
    previous hit came from another platform.
    """
    return signals_of(hit_summaries(hits))


def reader_state(events: DataFrame) -> DataFrame:
    """Saved items per reader from events (user_id, item_id, at, seq, saved, read).

    ``saved`` false deletes the save and forgets what was read; any other update
    saves the item and re-dates it; ``read`` sticks until it is set again.
    """
    when = F.struct("at", "seq")
    removed = F.max(F.when(F.col("saved") == F.lit(False), when))
    updating = F.col("saved").isNull() | F.col("saved")
    updated = F.max(F.when(updating, when))
    set_read = F.max(F.when(updating & F.col("read").isNotNull(), F.struct("at", "seq", "read")))
    folded = events.groupBy("user_id", "item_id").agg(
        removed.alias("removed"), updated.alias("updated"), set_read.alias("set_read")
    )
    never = F.col("removed").isNull()
    read_since = F.struct("set_read.at", "set_read.seq")
    return folded.filter(F.col("updated").isNotNull() & (never | (F.col("updated") > F.col("removed")))).select(
        "user_id",
        "item_id",
        iff(F.col("set_read.read") & (never | (read_since > F.col("removed")))).alias("is_read"),
        F.col("updated.at").alias("saved_at"),
    )


def replace_topic_selection(current: DataFrame, wanted: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (user_id, topic_id) selections, and readers whose request named no known topic.

    ``wanted`` has user_id and topic_name. Readers without a valid request keep what they have.
    """
    named = wanted.join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_name")
    resolved = named.select("user_id", "topic_id").distinct()
    served = resolved.select("user_id").distinct()
    kept = current.join(served, "user_id", "left_anti").select("user_id", "topic_id")
    failed = wanted.select("user_id").distinct().join(served, "user_id", "left_anti")
    return resolved.unionByName(kept), failed.withColumn("error", F.lit("NO_KNOWN_TOPIC"))


def of_kind(kind: str) -> Column:
    source_type = F.col("source_type")
    if kind == "feeds":
        return source_type.isin(FEED_TYPES)
    if kind == "discovery":
        return source_type.isin(DISCOVERY_TYPES)
    return F.lit(True)


def overdue_sources(sources: DataFrame, kind: str, now: Column) -> DataFrame:
    """Active sources of a kind whose last success (else fetch) is an interval or more ago."""
    last = F.coalesce("last_success_at", "last_fetched_at")
    interval = F.coalesce("fetch_interval_minutes", F.lit(DEFAULT_INTERVAL_MINUTES)).cast("bigint") * MICROS_PER_MINUTE
    due = last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= interval)
    return sources.filter(F.col("is_active") & of_kind(kind) & due)


def close_stale_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that never finished become failed ones."""
    age = F.unix_micros(now) - F.unix_micros("started_at")
    dead = (F.col("status") == "running") & (age > STALE_RUN_MINUTES * MICROS_PER_MINUTE)

    def closed(name: str, value: Column) -> Column:
        return F.when(dead, value).otherwise(F.col(name)).alias(name)

    changed = {
        "status": F.lit("failed"),
        "completed_at": now,
        "error_count": F.lit(1),
        "error_message": F.lit("TIMED_OUT"),
    }
    return runs.select(*[closed(name, changed[name]) if name in changed else F.col(name) for name in runs.columns])


EVENT_SCHEMA = (
    "client_event_id string, content_item_id string, type string, dwell_seconds double, "
    "completion_ratio double, at timestamp"
)


def parse_events(raw: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Events read from JSON text with a valid flag; nothing is dropped."""
    event = F.from_json(payload_col, EVENT_SCHEMA)
    parsed = raw.withColumn("event", event)
    dwell, ratio = F.col("event.dwell_seconds"), F.col("event.completion_ratio")
    valid = (
        F.col("event.client_event_id").isNotNull()
        & F.col("event.content_item_id").isNotNull()
        & iff(F.col("event.type").isin(EVENT_TYPES))
        & (dwell.isNull() | (dwell.between(0, MAX_DWELL_SECONDS) & (dwell == F.floor(dwell))))
        & (ratio.isNull() | ratio.between(0, 1))
    )
    return parsed.withColumn("valid", iff(valid))


def valid_events(raw: DataFrame, payload_col: str = "payload") -> DataFrame:
    return parse_events(raw, payload_col).filter("valid").select("event.*")


def dead_letters(raw: DataFrame, payload_col: str = "payload") -> DataFrame:
    return parse_events(raw, payload_col).filter(~F.col("valid")).select(*raw.columns)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per item, type and tumbling window; works on a stream and on a table."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", width), "content_item_id", "type").agg(
        F.count(F.lit(1)).alias("events")
    )
    return counted.select(F.col("window.start").alias("window_start"), "content_item_id", "type", "events")

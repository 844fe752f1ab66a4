"""Reports over runs, verdicts, sources and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.links import site_of
from gleaner.functions.language import Lexicon
from gleaner.functions.scoring import MICROS_PER_DAY, days_before, iff
from gleaner.operators.gate import DEFAULT_ARTICLE_AGE_DAYS, qualify

# Sizes of the top-k reports and the age of a stale source.
REJECTIONS_SHOWN = 50
RUNS_SHOWN = 20
STALE_SOURCE_DAYS = 7
BACKFILL_BATCH = 10
FAILURE_CODE = "^[A-Z0-9_:-]{2,80}$"


def reader_stats(saved: DataFrame, submissions: DataFrame, user_topics: DataFrame) -> DataFrame:
    """Per reader: saved links of their own, other saved posts, read saves, followed topics."""
    own = (
        submissions.filter((F.col("status") == "completed") & F.col("item_id").isNotNull())
        .select("user_id", "item_id", F.lit(True).alias("own"))
        .distinct()
    )
    saves = saved.join(own, ["user_id", "item_id"], "left").groupBy("user_id").agg(
        F.count_if(iff(F.col("own"))).alias("links"),
        F.count_if(~iff(F.col("own"))).alias("posts"),
        F.count_if(iff(F.col("is_read"))).alias("read"),
    )
    topics = user_topics.groupBy("user_id").agg(F.count(F.lit(1)).alias("topics"))
    return saves.join(topics, "user_id", "full_outer").na.fill(0, ["links", "posts", "read", "topics"])


def failure_key(url: Column, code: Column) -> Column:
    known = F.when(iff(code.rlike(FAILURE_CODE)), code).otherwise("FETCH_FAILED")
    return F.concat(F.coalesce(site_of(url), F.lit("unknown-host")), F.lit(":"), known)


def fetch_failures(attempts: DataFrame) -> DataFrame:
    """(failure, failures) over page fetches that carry an error code."""
    failed = attempts.filter(F.col("error_code").isNotNull())
    return failed.groupBy(failure_key(F.col("url"), F.col("error_code")).alias("failure")).agg(
        F.count(F.lit(1)).alias("failures")
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals over one pass of source runs, and whether some failed."""
    failed = F.count_if(F.col("status") == "failed")
    return runs.agg(
        F.count(F.lit(1)).alias("processed"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("fetched", "inserted", "duplicates", "rejected", "enriched")],
        failed.alias("failed"),
        F.when(failed > 0, "partial").otherwise("succeeded").alias("status"),
    )


def score_histogram(verdicts: DataFrame) -> DataFrame:
    """Verdicts per tenth of the score; a full score belongs to the last bucket."""
    low = F.least(F.lit(9), F.floor(F.col("score") * 10)).cast("int")
    label = F.concat(
        F.format_string("%.1f", low / 10), F.lit("-"), F.format_string("%.1f", (low + 1) / 10)
    )
    return verdicts.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("verdicts"))


def latest_rejections(log: DataFrame, sources: DataFrame, shown: int | None = None) -> DataFrame:
    """Rejections with the name of their source; the newest ``shown`` only, if asked (a page shows REJECTIONS_SHOWN)."""
    newest = log.filter(F.col("decision") == "rejected")
    if shown is not None:
        newest = newest.orderBy(F.col("created_at").desc(), "url_hash").limit(shown)
    named = sources.select("source_id", F.col("name").alias("source_name"))
    return newest.join(named, "source_id", "left").withColumn("source_name", F.coalesce("source_name", F.lit("Unknown source")))


def rejection_reasons(log: DataFrame, sources: DataFrame, shown: int | None = None) -> DataFrame:
    """Counts per reason; among the newest ``shown`` rejections only, if asked."""
    return latest_rejections(log, sources, shown).groupBy("reason").agg(F.count(F.lit(1)).alias("rejections"))


def freshness_audit(candidates: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Per source: accepted and rejected by each date reason, newest and oldest candidate.

    ``published_text`` is the date as the feed wrote it; ``published_at`` what could be read of it.
    """
    limits = sources.select("source_id", F.coalesce("max_article_age_days", F.lit(DEFAULT_ARTICLE_AGE_DAYS)).alias("age_limit"))
    given = F.coalesce("published_text", F.lit("")) != ""
    dated = F.col("published_at").isNotNull()
    fresh = iff(F.col("published_at") >= days_before(now, F.col("age_limit")))
    by_date = F.struct("published_at", "id")
    return (
        candidates.join(limits, "source_id")
        .groupBy("source_id")
        .agg(
            F.count_if(fresh).alias("accepted"),
            F.count_if(~given).alias("missing_date"),
            F.count_if(given & ~dated).alias("invalid_date"),
            F.count_if(dated & ~fresh).alias("older_than_cutoff"),
            F.max_by("id", F.when(dated, by_date)).alias("newest_id"),
            F.min_by("id", F.when(dated, by_date)).alias("oldest_id"),
        )
    )


def topic_audit(
    topics: DataFrame, sources: DataFrame, source_topics: DataFrame, items: DataFrame, item_topics: DataFrame, now: Column
) -> DataFrame:
    """Health of each topic, judged by its first official source."""
    official = sources.filter(F.coalesce("trust_tier", F.lit("official")) == "official")
    chosen = (
        source_topics.join(official, "source_id")
        .groupBy("topic_id")
        .agg(F.min(F.struct("name", "source_id", "last_error", "last_success_at")).alias("source"))
    )
    linked = item_topics.groupBy("topic_id").agg(F.count(F.lit(1)).alias("topic_items"))
    fresh_from = days_before(now, F.lit(DEFAULT_ARTICLE_AGE_DAYS))
    stored = items.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("source_items"),
        F.max("published_at").alias("newest_at"),
        F.min("published_at").alias("oldest_at"),
        F.count_if(iff(F.col("published_at") >= fresh_from)).alias("fresh_items"),
    )
    silent_for = F.unix_micros(now) - F.unix_micros("source.last_success_at")
    status = (
        F.when(F.col("source").isNull() | F.col("source.last_error").isNotNull(), "FAILED")
        .when(F.coalesce("source_items", F.lit(0)) == 0, "NO DATA")
        .when(iff(silent_for > STALE_SOURCE_DAYS * MICROS_PER_DAY), "STALE")
        .when(F.col("fresh_items") == 0, "WARNING")
        .otherwise("HEALTHY")
    )
    return (
        topics.join(chosen, "topic_id", "left")
        .join(linked, "topic_id", "left")
        .join(stored, F.col("source.source_id") == stored["source_id"], "left")
        .select(
            topics["topic_id"],
            topics["name"].alias("topic"),
            F.col("source.source_id").alias("source_id"),
            F.coalesce("source_items", F.lit(0)).alias("source_items"),
            F.coalesce("topic_items", F.lit(0)).alias("topic_items"),
            "newest_at",
            "oldest_at",
            status.alias("status"),
        )
    )


def recent_runs(runs: DataFrame, sources: DataFrame, shown: int = RUNS_SHOWN) -> DataFrame:
    newest = runs.orderBy(F.col("started_at").desc(), "run_id").limit(shown)
    return newest.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id", "left")


def last_run_per_job(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every job with its latest run, if it has any."""
    latest = runs.groupBy("source_id").agg(F.max(F.struct("started_at", "run_id", "status")).alias("last"))
    return jobs.join(latest, "source_id", "left").select("source_id", "name", "last.started_at", "last.status")


def backfill_pass(
    items: DataFrame,
    pages: DataFrame,
    context: DataFrame,
    now: Column,
    batch: int | None = None,
    *,
    lexicon: Lexicon,
) -> DataFrame:
    """Re-judge stored rows that were never backfilled, oldest first.

    ``pages`` has canonical_url, image_url, body_text and failed. A row whose
    page could not be fetched is stamped, not judged. ``batch=None`` takes all.
    """
    pending = items.filter(F.col("backfilled_at").isNull())
    if batch is not None:
        pending = pending.orderBy("fetched_at", "id").limit(batch)
    page = pages.select(
        "canonical_url",
        F.col("image_url").alias("page_image"),
        F.col("body_text").alias("page_body"),
        iff(F.col("failed")).alias("fetch_failed"),
    )
    filled = (
        pending.join(page, "canonical_url", "left")
        .withColumn("failed", F.coalesce("fetch_failed", F.lit(True)))
        .withColumn("kept_image", F.when(F.col("failed"), F.col("image_url")).otherwise(F.coalesce("image_url", "page_image")))
        .withColumn("kept_body", F.when(F.col("failed"), F.col("body_content")).otherwise(F.coalesce("body_content", "page_body")))
    )
    nothing = F.lit(None)
    prepared = filled.select(
        "id", "source_id", "title", "summary", "canonical_url", "published_at", "failed",
        F.col("kept_body").alias("body_text"),
        nothing.cast("string").alias("kind"),
        nothing.cast("string").alias("platform"),
        nothing.cast("bigint").alias("engagement_count"),
        F.lit(False).alias("paywalled"),
        F.lit(False).alias("duplicate"),
        (F.coalesce("kept_image", F.lit("")) != "").alias("image_found"),
        F.coalesce(F.regexp_count("kept_body", F.lit(r"\S+")), F.lit(0)).alias("body_words"),
        (F.col("image_url").isNull() & F.col("kept_image").isNotNull()).alias("image_added"),
        (F.col("body_content").isNull() & F.col("kept_body").isNotNull()).alias("body_added"),
    )
    failed = F.col("failed")
    return qualify(prepared, context, now, lexicon=lexicon).select(
        "id",
        "image_found",
        "body_words",
        F.when(~failed, F.col("score")).alias("score"),
        F.when(failed, "extraction_failed").otherwise(F.col("reason")).alias("reason"),
        F.when(failed, "extraction_failed").when(F.col("accepted"), "kept").otherwise("hidden").alias("action"),
        "image_added",
        "body_added",
    )


def backfill_report(passed: DataFrame) -> DataFrame:
    return passed.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("image_added").alias("images_added"),
        F.count_if("body_added").alias("bodies_added"),
        F.count_if(F.col("action") == "hidden").alias("hidden"),
        F.count_if(F.col("action") == "extraction_failed").alias("extraction_failures"),
    )

"""One ingest pass over any number of sources: payload candidates in, table changes out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.language import Lexicon
from gleaner.functions.links import url_hash
from gleaner.functions.scoring import iff
from gleaner.operators import gate, keys, state, topics
from gleaner.operators.skew import checked_join
from gleaner.session import settled
from gleaner.sources.snapshots import Change, Snapshots
from gleaner.sources.tables import schema_of


@dataclass
class IngestResult:
    """What a pass decided: verdicts of new candidates, rows to store, links to add, runs."""

    verdicts: DataFrame
    new_items: DataFrame
    topic_links: DataFrame
    hits: DataFrame
    runs: DataFrame
    page_attempts: DataFrame | None = None


def ingest_batch(
    candidates: DataFrame,
    items: DataFrame,
    sources: DataFrame,
    source_topics: DataFrame,
    topic_aliases: DataFrame,
    now: Column,
    pages: DataFrame | None = None,
    discovery: bool = False,
    *,
    lexicon: Lexicon,
) -> IngestResult:
    """Freshness, matching, enrichment, gate and in-run duplicates for all sources at once.

    ``candidates`` come from a normaliser; ``items`` is the stored corpus.
    Sources that fail (no topics declared) get a failed run and store nothing.
    """
    context = gate.source_context(sources, source_topics, topic_aliases, discovery)
    sound = context.filter(F.col("error").isNull())
    optional = {
        "payload_id": "string", "external_id": "string", "author": "string", "image_url": "string",
        "kind": "string", "platform": "string", "engagement_count": "bigint", "signal_count": "bigint",
    }
    for name, kind in optional.items():
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, F.lit(None).cast(kind))
    known = candidates.join(sound.select("source_id"), "source_id", "left_semi").withColumn(
        "url_hash", url_hash(F.col("canonical_url"))
    )
    # One row per source and link; a source may repeat an entry across payloads.
    first = F.struct("payload_id", "position")
    rest = [name for name in known.columns if name not in ("id", "source_id", "url_hash")]
    known = known.groupBy("source_id", "url_hash").agg(F.min_by(F.struct(*rest), first).alias("kept"))
    known = known.select("source_id", "url_hash", "kept.*").withColumn("id", F.concat_ws(":", "source_id", "url_hash"))
    fresh = gate.fresh_candidates(known, sources, now)
    matched = settled(keys.match_existing(fresh, items))
    novel = matched.filter(F.col("existing_id").isNull())
    attempts = None
    if pages is not None:
        attempts = settled(gate.page_attempts(novel, pages))
        read = pages.filter(F.col("error_code").isNull()) if "error_code" in pages.columns else pages
        novel = settled(gate.enrich_from_pages(novel, read))
    else:
        novel = novel.withColumn("enriched", F.lit(False))
    titles = gate.recent_titles(items, now)
    judged = settled(
        gate.qualify(
            novel.withColumn("paywalled", F.lit(False)).withColumn("duplicate", F.lit(False)), context, now, titles, lexicon=lexicon
        )
    )
    walked = gate.near_duplicate_in_batch(judged.withColumn("eligible", F.col("accepted")), within=None)
    # A hard reject that comes before near_duplicate_title in the gate keeps its reason.
    outranked = F.col("reason").isin("duplicate_url_hash", "aggregator_domain", "spam_markers", "paywalled_without_summary")
    doubled = F.col("in_batch") & ~outranked
    topic = context.select("source_id", F.get("topic_ids", F.lit(0)).alias("topic_id"))
    walked = checked_join(walked, topic, "source_id", spread_by="id")
    verdicts = (
        walked.withColumn("reason", F.when(doubled, "near_duplicate_title").otherwise(F.col("reason")))
        .withColumn("score", F.when(doubled, 0.0).otherwise(F.col("score")))
        .withColumn("accepted", F.col("accepted") & ~doubled)
        .withColumn("created_at", now)
    )
    verdicts = settled(verdicts)
    # Two sources may carry one new link in the same pass; the smaller source id stores it.
    order = F.struct("source_id", "position")
    stored_columns = ["source_id", "external_id", "title", "author", "summary", "body_text", "image_url", "published_at", "canonical_url"]
    stored = novel.join(verdicts.filter("accepted").select("id"), "id", "left_semi")
    new_items = (
        stored.groupBy("url_hash")
        .agg(F.min_by(F.struct(*stored_columns), order).alias("kept"))
        .select("url_hash", "kept.*")
        .withColumn("id", F.col("url_hash"))
        .withColumnRenamed("body_text", "body_content")
        .withColumn("fetched_at", now)
        .withColumn("is_hidden", F.lit(False))
    )
    accepted = stored.select("source_id", "url_hash", "title", "summary", F.col("body_text").alias("body_content"), F.col("url_hash").alias("id"))
    seen = matched.filter(F.col("existing_id").isNotNull()).select(
        "source_id", "url_hash", "title", "summary", F.col("body_text").alias("body_content"), F.col("existing_id").alias("id")
    )
    linked = accepted.unionByName(seen)
    links = topics.link_topics(linked, source_topics, topics.classify(linked, topic_aliases))
    hits = (
        matched.join(verdicts.filter("accepted").select("source_id", "url_hash", F.lit(True).alias("stored")), ["source_id", "url_hash"], "left")
        .filter(F.col("existing_id").isNotNull() | F.col("stored"))
        .select(
            F.coalesce("existing_id", "url_hash").alias("item_id"),
            F.concat_ws(":", "source_id", "url_hash").alias("hit_id"),
            now.alias("seen_at"),
            "platform",
            F.coalesce("signal_count", "engagement_count").cast("double").alias("reported"),
            "source_id",
            F.col("existing_source_id").alias("stored_source_id"),
        )
        .filter(F.col("platform").isNotNull())
    )
    counts = (
        matched.select("source_id", "url_hash", F.col("existing_id").isNotNull().alias("seen"))
        .join(verdicts.select("source_id", "url_hash", "accepted", "enriched"), ["source_id", "url_hash"], "left")
        .join(new_items.select("source_id", "url_hash", F.lit(True).alias("kept")), ["source_id", "url_hash"], "left")
        .groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("fetched"),
            F.count_if(iff(F.col("kept"))).alias("inserted"),
            F.count_if(F.col("seen") | (iff(F.col("accepted")) & ~iff(F.col("kept")))).alias("duplicates"),
            F.count_if(~F.col("seen") & ~iff(F.col("accepted"))).alias("rejected"),
            F.count_if(iff(F.col("enriched"))).alias("enriched"),
        )
    )
    zero = ["fetched", "inserted", "duplicates", "rejected", "enriched", "pages_asked", "pages_failed"]
    if attempts is None:
        asked = counts.select("source_id", F.lit(0).alias("pages_asked"), F.lit(0).alias("pages_failed"))
    else:
        failed = F.count_if(F.col("error_code").isNotNull())
        asked = attempts.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages_asked"), failed.alias("pages_failed"))
    offered = candidates.select("source_id").distinct()
    runs = (
        offered.join(context.select("source_id", "error"), "source_id", "left")
        .join(counts, "source_id", "left")
        .join(asked, "source_id", "left")
        .na.fill(0, zero)
        .select(
            "source_id",
            *zero,
            F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"),
            F.col("error").alias("error_message"),
            now.alias("started_at"),
        )
    )
    return IngestResult(verdicts, new_items, links, hits, runs, attempts)


def _items_to_store(new_items: DataFrame) -> DataFrame:
    """New items as the corpus stores them."""
    counted = keys.word_counts(keys.with_dedupe_key(new_items))
    schema = schema_of("content_items")
    have = [F.col(f.name).cast(f.dataType) if f.name in counted.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return counted.select(*[column.alias(field.name) for column, field in zip(have, schema, strict=True)])


def _seen_sources(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """The rows of sources that took part, as their run leaves them."""
    succeeded = F.col("run_status") == "succeeded"
    ended = {
        "last_fetched_at": now,
        "last_success_at": F.when(succeeded, now).otherwise(F.col("last_success_at")),
        "last_error": F.col("run_error"),
    }
    told = runs.select("source_id", F.col("status").alias("run_status"), F.col("error_message").alias("run_error"))
    return sources.join(told, "source_id").withColumns(ended).select(*sources.columns)


def _run_rows(runs: DataFrame, writer: str, batch: int, now: Column) -> DataFrame:
    failed = F.col("status") == "failed"
    return runs.select(
        F.concat_ws(":", F.lit(writer), F.lit(batch).cast("string"), "source_id").alias("run_id"),
        "source_id",
        "started_at",
        now.alias("completed_at"),
        "status",
        F.col("fetched").cast("int").alias("items_seen"),
        F.col("inserted").cast("int").alias("items_inserted"),
        F.lit(0).alias("items_updated"),
        (F.col("duplicates") + F.col("rejected")).cast("int").alias("items_skipped"),
        F.when(failed, 1).otherwise(0).alias("error_count"),
        "error_message",
        *[F.col(name).cast("int").alias(name) for name in ("enriched", "pages_asked", "pages_failed")],
    )


def changes_of(result: IngestResult, tables: Snapshots, base: int, writer: str, batch: int, now: Column) -> dict[str, Change]:
    """What a pass changes in the stored tables as of version ``base``.

    Only rows that the batch touches are read back: the signals of items that were hit,
    the sources that took part, the logged verdicts of the days at hand.
    """
    summaries = settled(state.hit_summaries(result.hits))
    known = tables.read("signal_summaries", base)
    if known is not None:
        touched = known.join(summaries.select("item_id"), "item_id", "left_semi")
        summaries = state.merge_hit_summaries(touched, summaries)
    verdicts = state.verdict_log(result.verdicts)
    logged = tables.read("discovery_candidates", base)
    if logged is not None:
        days = verdicts.select("day").distinct()
        verdicts = verdicts.join(logged.join(days, "day", "left_semi").select("url_hash", "day"), ["url_hash", "day"], "left_anti")
    sources = tables.read("sources", base)
    return {
        "content_items": Change(_items_to_store(result.new_items)),
        "content_item_topics": Change(result.topic_links.select("item_id", "topic_id").distinct(), ["item_id", "topic_id"]),
        "signal_summaries": Change(summaries, ["item_id"]),
        "discovery_candidates": Change(verdicts),
        "sources": Change(_seen_sources(sources, result.runs, now), ["source_id"]),
        "ingestion_runs": Change(_run_rows(result.runs, writer, batch, now)),
    }


def ingest_into(
    tables: Snapshots,
    writer: str,
    batch: int,
    candidates: DataFrame,
    source_topics: DataFrame,
    topic_aliases: DataFrame,
    now: Column,
    pages: DataFrame | None = None,
    discovery: bool = False,
    *,
    lexicon: Lexicon,
) -> bool:
    """Run a pass over the stored tables and publish all its changes at once.

    Items, topic links, folded signals, verdicts, sources and runs of the batch are seen
    together or not at all. False, and nothing changes, if the writer's batch is in
    already; Conflict if another writer published meanwhile.
    """
    if tables.done(writer, batch):
        return False
    base = tables.version()
    result = ingest_batch(
        candidates, tables.read("content_items", base), tables.read("sources", base), source_topics, topic_aliases, now,
        pages, discovery, lexicon=lexicon,
    )
    result.runs = settled(result.runs)
    return tables.commit(writer, batch, changes_of(result, tables, base, writer, batch, now), base)

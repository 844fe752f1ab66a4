"""Queries of the ingest pass: over stored tables, in one batch and as a stream, with the pass in SQL."""

import uuid

from pyspark.sql import functions as F

from gleaner.operators import state
from gleaner.operators.ingest import ingest_into
from gleaner.plans import fixtures
from gleaner.plans.feed_queries import matches_view
from gleaner.plans.fixtures import Fixtures
from gleaner.plans.gate_queries import (
    CONTEXT,
    CONTEXT_VIEWS,
    ENRICHED,
    RECENT,
    language_view,
    near_sql,
    scored_view,
    verdict_view,
)
from gleaner.plans.registry import query, stamp
from gleaner.plans.stream_fixtures import streamed_table
from gleaner.plans.views import NOW, dedupe_key, shingles, stamp as sql_stamp, with_views
from gleaner.session import shared_dir
from gleaner.sources.snapshots import Change, Snapshots
from gleaner.sources.tables import schema_of
from gleaner.streaming import jobs

STORED = f"""
    SELECT id, CAST(NULL AS VARCHAR) AS source_id, title, 'https://stored.example.com/' || id AS canonical_url, sha256('https://stored.example.com/' || id) AS url_hash, fetched_at
    FROM fx_stored_titles
    UNION ALL
    SELECT 'old' || id, 'src0', 'Archived number ' || id, canonical_url, sha256(canonical_url), {NOW} - INTERVAL 40 DAY FROM fx_items WHERE n % 7 = 2"""

# Candidates of sound sources, one per source and link, inside the age limit; those that are stored already have existing_id.
MATCHED = f"""
    SELECT k.* EXCLUDE (id), k.source_id || ':' || k.url_hash AS id, o.id AS existing_id, o.source_id AS existing_source_id
    FROM (SELECT c.*, sha256(c.canonical_url) AS url_hash FROM fx_candidates c JOIN context x USING (source_id) WHERE x.error IS NULL
        QUALIFY row_number() OVER (PARTITION BY c.source_id, c.canonical_url ORDER BY position) = 1) k
    JOIN fx_sources s USING (source_id) LEFT JOIN stored o ON o.url_hash = k.url_hash
    WHERE k.published_at >= {NOW} - to_days(CAST(coalesce(s.max_article_age_days, 30) AS INTEGER))"""

NOVEL = f"""
    SELECT m.* EXCLUDE (author, summary, body_text, image_url, paywalled, duplicate), e.author, e.summary, e.body_text, e.image_url, e.enriched,
        FALSE AS paywalled, FALSE AS duplicate
    FROM matched m JOIN ({ENRICHED.replace('FROM fx_candidates', 'FROM matched WHERE existing_id IS NULL').replace('fx_page_metadata', 'read_pages')}) e USING (id)"""

WALK = f"""
    SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS id, FALSE AS in_batch, CAST([] AS VARCHAR[][]) AS held
    UNION ALL
    SELECT f.place, f.id, hit, CASE WHEN f.accepted AND NOT hit THEN list_append(w.held, f.s) ELSE w.held END
    FROM walk w JOIN (SELECT row_number() OVER (ORDER BY n.source_id, n.position, n.id) AS place, n.id, v.accepted, {shingles('n.title')} AS s
        FROM novel n JOIN verdict v USING (id)) f ON f.place = w.place + 1,
    LATERAL (SELECT len(list_filter(w.held, lambda h: len(list_intersect(h, f.s)) > 0 AND
        len(list_intersect(h, f.s)) / (len(h) + len(f.s) - len(list_intersect(h, f.s))) > 0.8e0)) > 0 AS hit)"""

JUDGED = """
    SELECT n.*, CASE WHEN doubled THEN 'near_duplicate_title' ELSE v.reason END AS reason, v.accepted AND NOT doubled AS accepted
    FROM novel n JOIN verdict v USING (id) JOIN walk w ON w.id = n.id,
    LATERAL (SELECT w.in_batch AND v.reason NOT IN ('duplicate_url_hash', 'aggregator_domain', 'spam_markers', 'paywalled_without_summary') AS doubled)"""

NEW_ITEMS = "SELECT * FROM judged WHERE accepted QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY source_id, position) = 1"

PASS = {
    "context": CONTEXT,
    "stored": STORED,
    "matched": MATCHED,
    "read_pages": "SELECT * FROM fx_page_metadata WHERE NOT failed",
    "novel": NOVEL,
    "recent": RECENT.format("stored"),
    "near": near_sql("novel", "recent"),
    "scored": scored_view("novel"),
    "language": language_view("novel", "body_text"),
    "verdict": verdict_view(),
    "walk": WALK,
    "judged": JUDGED,
    "new_items": NEW_ITEMS,
}
PASS_VIEWS = ("fx_candidates", *CONTEXT_VIEWS, "fx_stored_titles", "fx_items", "fx_page_metadata")

LINKED = """
    SELECT url_hash AS id, source_id, title, summary, body_text AS body_content FROM judged WHERE accepted
    UNION ALL SELECT existing_id, source_id, title, summary, body_text FROM matched WHERE existing_id IS NOT NULL"""
HITS = """
    SELECT coalesce(m.existing_id, m.url_hash) AS item_id, m.platform, m.engagement_count, coalesce(m.existing_source_id <> m.source_id, FALSE) AS other
    FROM matched m LEFT JOIN judged j USING (id) WHERE (m.existing_id IS NOT NULL OR j.accepted) AND m.platform IS NOT NULL AND m.engagement_count IS NOT NULL"""

ITEMS_SQL = with_views(
    f"""SELECT i.id, i.source_id, i.title, i.stored_hash, i.chars, coalesce(t.topics, '') AS topics, coalesce(s.engagement_count, -1) AS engagement_count,
        coalesce(s.source_count, 0) AS source_count, s.platform
    FROM (SELECT url_hash AS id, source_id, title, sha256({dedupe_key('canonical_url')}) AS stored_hash, coalesce(length(body_text), -1) AS chars FROM new_items
        UNION ALL SELECT id, source_id, title, url_hash, -1 FROM stored) i
    LEFT JOIN (SELECT id, string_agg(CAST(topic_id AS VARCHAR), '|' ORDER BY topic_id) AS topics FROM (
        SELECT id, topic_id FROM matches UNION SELECT l.id, s.topic_id FROM linked l JOIN fx_source_topics s USING (source_id)) GROUP BY id) t USING (id)
    LEFT JOIN (SELECT item_id AS id, max(engagement_count) AS engagement_count, CASE WHEN bool_or(other) THEN 2 ELSE 1 END AS source_count, any_value(platform) AS platform
        FROM hits GROUP BY item_id) s USING (id)""",
    *PASS_VIEWS,
    recursive=True,
    extra={**PASS, "linked": LINKED, "hits": HITS, "matches": matches_view("linked")},
)

RUNS_SQL = with_views(
    f"""SELECT s.source_id, {sql_stamp('s.last_fetched_at')} AS last_fetched_at, {sql_stamp('s.last_success_at')} AS last_success_at, s.last_error,
        r.status, r.items_seen, r.items_inserted, r.items_skipped, r.error_count, r.enriched, r.pages_asked, r.pages_failed
    FROM (SELECT s.source_id, CASE WHEN o.source_id IS NULL THEN s.last_fetched_at ELSE {NOW} END AS last_fetched_at,
            CASE WHEN o.source_id IS NULL OR x.error IS NOT NULL THEN s.last_success_at ELSE {NOW} END AS last_success_at,
            CASE WHEN o.source_id IS NULL THEN s.last_error ELSE x.error END AS last_error
        FROM fx_sources s LEFT JOIN offered o USING (source_id) LEFT JOIN context x USING (source_id)) s
    LEFT JOIN (SELECT o.source_id, CASE WHEN x.error IS NULL THEN 'succeeded' ELSE 'failed' END AS status, coalesce(c.seen, 0) AS items_seen,
            coalesce(c.inserted, 0) AS items_inserted, coalesce(c.seen - c.inserted, 0) AS items_skipped,
            CASE WHEN x.error IS NULL THEN 0 ELSE 1 END AS error_count, coalesce(c.enriched, 0) AS enriched,
            coalesce(c.asked, 0) AS pages_asked, coalesce(c.failed, 0) AS pages_failed
        FROM offered o LEFT JOIN context x USING (source_id) LEFT JOIN (
            SELECT m.source_id, count(*) AS seen, count(i.id) AS inserted, count(*) FILTER (j.enriched) AS enriched,
                count(*) FILTER (wanted) AS asked, count(*) FILTER (wanted AND (p.canonical_url IS NULL OR p.failed)) AS failed
            FROM matched m LEFT JOIN judged j ON j.id = m.id LEFT JOIN new_items i ON i.id = m.id LEFT JOIN fx_page_metadata p ON p.canonical_url = m.canonical_url,
            LATERAL (SELECT m.existing_id IS NULL AND (coalesce(m.image_url, '') = '' OR coalesce(len(regexp_extract_all(lower(m.body_text), '[a-z0-9.+#/-]+')), 0) < 400) AS wanted)
            GROUP BY m.source_id) c USING (source_id)) r USING (source_id)""",
    *PASS_VIEWS,
    recursive=True,
    extra={**PASS, "offered": "SELECT DISTINCT source_id FROM fx_candidates"},
)


def _pages(fx):
    return fx.page_metadata().withColumn("error_code", F.when(F.col("failed"), "HTTP_403")).drop("failed")


def _seeded(fx) -> Snapshots:
    """Stored tables before the pass."""
    tables = Snapshots(fx.spark, f"{shared_dir(fx.spark)}/tables-{uuid.uuid4().hex}")
    titled = fx.stored_titles().select(
        "id", F.lit(None).cast("string").alias("source_id"), "title", F.concat(F.lit("https://stored.example.com/"), "id").alias("canonical_url"), "fetched_at"
    )
    archived = fx.items().filter("n % 7 = 2").select(
        F.concat(F.lit("old"), "id").alias("id"), F.lit("src0").alias("source_id"), F.concat(F.lit("Archived number "), "id").alias("title"),
        "canonical_url", fixtures.minus_hours(F.lit(40 * 24)).alias("fetched_at"),
    )
    stored = titled.unionByName(archived).withColumn("url_hash", F.sha2("canonical_url", 256))
    schema = schema_of("content_items")
    have = [F.col(f.name) if f.name in stored.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    tables.commit("seed", 0, {"content_items": Change(stored.select(*have)), "sources": Change(fx.sources(), ["source_id"])})
    return tables


def _items(tables: Snapshots):
    """Stored items with their topics and signals after a pass."""
    items = tables.read("content_items").select(
        "id", "source_id", "title", "url_hash", F.sha2("dedupe_key", 256).alias("key_hash"), F.coalesce(F.length("body_content"), F.lit(-1)).alias("chars")
    )
    links = tables.read("content_item_topics").groupBy("item_id").agg(
        F.array_join(F.array_sort(F.collect_set("topic_id")).cast("array<string>"), "|").alias("topics")
    )
    signals = state.signals_of(tables.read("signal_summaries"))
    return (
        items.join(links, items["id"] == links["item_id"], "left").drop("item_id")
        .join(signals, items["id"] == signals["item_id"], "left")
        .select(
            "id", "source_id", "title", F.coalesce("key_hash", "url_hash").alias("stored_hash"), F.col("chars").cast("bigint").alias("chars"),
            F.coalesce("topics", F.lit("")).alias("topics"), F.coalesce("engagement_count", F.lit(-1)).cast("bigint").alias("engagement_count"),
            F.coalesce("source_count", F.lit(0)).alias("source_count"), "platform",
        )
    )


def _pass_over(fx, tables: Snapshots) -> None:
    candidates = fx.candidates().withColumn("payload_id", F.lit("p")).drop("paywalled", "duplicate", "fetched_at")
    ingest_into(
        tables, "ingest", 0, candidates, fx.source_topics(), fx.topic_aliases(), fixtures.now(), _pages(fx), lexicon=fixtures.LEXICON
    )


@query("ingest_items", ITEMS_SQL)
def ingest_items(fx):
    tables = _seeded(fx)
    _pass_over(fx, tables)
    return _items(tables)


@query("ingest_runs", RUNS_SQL)
def ingest_runs(fx):
    tables = _seeded(fx)
    _pass_over(fx, tables)
    runs = tables.read("ingestion_runs").select(
        "source_id", "status", "items_seen", "items_inserted", "items_skipped", "error_count", "enriched", "pages_asked", "pages_failed"
    )
    sources = tables.read("sources").select(
        "source_id", stamp("last_fetched_at").alias("last_fetched_at"), stamp("last_success_at").alias("last_success_at"), "last_error"
    )
    return sources.join(runs, "source_id", "left")


class _Arrived(Fixtures):
    """The fixture views over documents that a micro-batch brings."""

    def __init__(self, fx: Fixtures, documents):
        super().__init__(fx.spark, fx.folder)
        self._tables["documents"] = documents


@query("ingest_stream", ITEMS_SQL)
def ingest_stream(fx):
    tables = _seeded(fx)

    def normalize(batch):
        return _Arrived(fx, batch).candidates().withColumn("payload_id", F.lit("p")).drop("paywalled", "duplicate", "fetched_at")

    def dictionaries(_):
        return {"source_topics": fx.source_topics(), "topic_aliases": fx.topic_aliases(), "pages": _pages(fx)}

    checkpoint = f"{shared_dir(fx.spark)}/ingest-{uuid.uuid4().hex}"
    job = jobs.ingest_stream(streamed_table(fx, "documents"), normalize, tables, dictionaries, checkpoint, fixtures.now(), lexicon=fixtures.LEXICON)
    job.awaitTermination()
    return _items(tables)

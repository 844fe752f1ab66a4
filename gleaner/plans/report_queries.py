"""Queries of reports, state folds and streaming twins."""

import uuid

from pyspark.sql import functions as F

from gleaner.operators import gate, quota, reports, state
from gleaner.operators.ingest import ingest_batch
from gleaner.plans import fixtures
from gleaner.plans.gate_queries import CONTEXT, CONTEXT_VIEWS, language_view, qualified, scored_view, verdict_view, QUALIFIED, SCORE_VIEWS
from gleaner.plans.registry import query, rounded, stamp
from gleaner.plans.stream_fixtures import StreamFixtures
from gleaner.plans.views import NOW, quoted, stamp as sql_stamp, with_views
from gleaner.session import shared_dir
from gleaner.sources import feeds
from gleaner.sources.snapshots import Snapshots
from gleaner.streaming import jobs


@query(
    "reader_stats",
    with_views(
        """SELECT coalesce(s.user_id, t.user_id) AS user_id, coalesce(links, 0) AS links, coalesce(posts, 0) AS posts,
            coalesce("read", 0) AS "read", coalesce(topics, 0) AS topics
        FROM (SELECT user_id, count(*) FILTER (own) AS links, count(*) FILTER (NOT own) AS posts, count(*) FILTER (is_read) AS "read"
            FROM (SELECT *, (user_id, item_id) IN (SELECT (user_id, item_id) FROM fx_submissions WHERE status = 'completed') AS own FROM fx_saved) GROUP BY 1) s
        FULL OUTER JOIN (SELECT user_id, count(*) AS topics FROM fx_user_topics GROUP BY 1) t ON s.user_id = t.user_id""",
        "fx_saved", "fx_submissions", "fx_user_topics",
    ),
)
def reader_stats(fx):
    return reports.reader_stats(fx.saved(), fx.submissions(), fx.user_topics())


@query(
    "run_summary",
    with_views(
        """SELECT count(*) AS processed, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(duplicates) AS BIGINT) AS duplicates,
            CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(enriched) AS BIGINT) AS enriched, count(*) FILTER (status = 'failed') AS failed,
            CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM fx_runs""",
        "fx_runs",
    ),
)
def run_summary(fx):
    return reports.run_summary(fx.runs())


@query(
    "fetch_failures",
    with_views(
        """SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') || ':' ||
            CASE WHEN regexp_matches(error_code, '^[A-Z0-9_:-]{2,80}$') THEN error_code ELSE 'FETCH_FAILED' END AS failure, count(*) AS failures
        FROM fx_fetch_attempts WHERE error_code IS NOT NULL GROUP BY 1""",
        "fx_fetch_attempts",
    ),
)
def fetch_failures(fx):
    return reports.fetch_failures(fx.fetch_attempts())


@query(
    "score_histogram",
    with_views(
        """SELECT printf('%.1f', b / 10e0) || '-' || printf('%.1f', (b + 1) / 10e0) AS bucket, count(*) AS verdicts
        FROM (SELECT least(9, CAST(floor(score * 10) AS INTEGER)) AS b FROM fx_verdicts) GROUP BY 1""",
        "fx_verdicts",
    ),
)
def score_histogram(fx):
    return reports.score_histogram(fx.verdicts())


@query(
    "score_histogram_gate",
    with_views(
        """SELECT printf('%.1f', b / 10e0) || '-' || printf('%.1f', (b + 1) / 10e0) AS bucket, count(*) AS verdicts
        FROM (SELECT least(9, CAST(floor(score * 10) AS INTEGER)) AS b FROM verdict) GROUP BY 1""",
        *SCORE_VIEWS, "fx_stored_titles", extra=QUALIFIED,
    ),
)
def score_histogram_gate(fx):
    return reports.score_histogram(qualified(fx))


LOG = """SELECT url_hash, source_id, reason, created_at FROM fx_verdict_log WHERE decision = 'rejected'"""


@query("rejection_reasons", with_views(f"SELECT reason, count(*) AS rejections FROM ({LOG}) GROUP BY reason", "fx_verdict_log"))
def rejection_reasons(fx):
    return reports.rejection_reasons(state.verdict_log(fx.verdicts()), fx.sources())


@query(
    "latest_rejections",
    with_views(f"SELECT url_hash, coalesce(s.name, 'Unknown source') AS source_name, reason, {sql_stamp('created_at')} AS created_at FROM ({LOG}) l LEFT JOIN fx_sources s USING (source_id)", "fx_verdict_log", "fx_sources"),
)
def latest_rejections(fx):
    shown = reports.latest_rejections(state.verdict_log(fx.verdicts()), fx.sources())
    return shown.select("url_hash", "source_name", "reason", stamp("created_at").alias("created_at"))


@query(
    "freshness_audit",
    with_views(
        f"""SELECT source_id, count(*) FILTER (fresh) AS accepted, count(*) FILTER (written = '') AS missing_date,
            count(*) FILTER (written <> '' AND published_at IS NULL) AS invalid_date, count(*) FILTER (published_at IS NOT NULL AND NOT fresh) AS older_than_cutoff,
            arg_max(id, k) FILTER (published_at IS NOT NULL) AS newest_id, arg_min(id, k) FILTER (published_at IS NOT NULL) AS oldest_id
        FROM (SELECT c.*, CASE WHEN n % 100 = 0 THEN '' WHEN published_at IS NULL THEN 'soon' ELSE 'x' END AS written, {{'a': published_at, 'b': c.id}} AS k,
                coalesce(published_at >= {NOW} - to_days(CAST(coalesce(max_article_age_days, 30) AS INTEGER)), FALSE) AS fresh
            FROM fx_candidates c JOIN fx_sources USING (source_id)) GROUP BY source_id""",
        "fx_candidates", "fx_sources",
    ),
)
def freshness_audit(fx):
    written = F.when(F.col("n") % 100 == 0, "").when(F.col("published_at").isNull(), "soon").otherwise("x")
    return reports.freshness_audit(fx.candidates().withColumn("published_text", written), fx.sources(), fixtures.now())


@query(
    "topic_audit",
    with_views(
        f"""SELECT t.topic_id, t.name AS topic, c.s.source_id AS source_id, coalesce(i.source_items, 0) AS source_items, coalesce(l.topic_items, 0) AS topic_items,
            {sql_stamp('i.newest_at')} AS newest_at, {sql_stamp('i.oldest_at')} AS oldest_at,
            CASE WHEN c.s IS NULL OR c.s.last_error IS NOT NULL THEN 'FAILED' WHEN coalesce(i.source_items, 0) = 0 THEN 'NO DATA'
                WHEN coalesce(epoch_us({NOW}) - epoch_us(c.s.last_success_at) > 604800000000, FALSE) THEN 'STALE'
                WHEN i.fresh_items = 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status
        FROM fx_topics t
        LEFT JOIN (SELECT topic_id, arg_min(s, s.name) AS s FROM fx_source_topics JOIN fx_sources s USING (source_id)
            WHERE coalesce(trust_tier, 'official') = 'official' GROUP BY 1) c ON c.topic_id = t.topic_id
        LEFT JOIN (SELECT topic_id, count(*) AS topic_items FROM fx_item_topics GROUP BY 1) l ON l.topic_id = t.topic_id
        LEFT JOIN (SELECT source_id, count(*) AS source_items, max(published_at) AS newest_at, min(published_at) AS oldest_at,
            count(*) FILTER (published_at >= {NOW} - INTERVAL 30 DAY) AS fresh_items FROM fx_items GROUP BY 1) i ON i.source_id = c.s.source_id""",
        "fx_topics", "fx_source_topics", "fx_sources", "fx_item_topics", "fx_items",
    ),
)
def topic_audit(fx):
    audit = reports.topic_audit(fx.topics(), fx.sources(), fx.source_topics(), fx.items(), fx.item_topics(), fixtures.now())
    return audit.withColumn("newest_at", stamp("newest_at")).withColumn("oldest_at", stamp("oldest_at"))


@query(
    "recent_runs",
    with_views(
        f"SELECT run_id, s.name AS source_name, status, {sql_stamp('started_at')} AS started_at FROM (SELECT * FROM fx_runs ORDER BY started_at DESC, run_id LIMIT 20) r LEFT JOIN fx_sources s USING (source_id)",
        "fx_runs", "fx_sources",
    ),
)
def recent_runs(fx):
    return reports.recent_runs(fx.runs(), fx.sources()).select("run_id", "source_name", "status", stamp("started_at").alias("started_at"))


@query(
    "last_run_per_job",
    with_views(
        f"""SELECT s.source_id, s.name, {sql_stamp('r.started_at')} AS started_at, r.status FROM fx_sources s
        LEFT JOIN LATERAL (SELECT started_at, status FROM fx_runs r WHERE r.source_id = s.source_id ORDER BY started_at DESC, run_id DESC LIMIT 1) r ON TRUE""",
        "fx_runs", "fx_sources",
    ),
)
def last_run_per_job(fx):
    latest = reports.last_run_per_job(fx.sources(), fx.runs())
    return latest.withColumn("started_at", stamp("started_at"))


BACKFILL = {
    "context": CONTEXT,
    "filled": """SELECT i.id, i.source_id, i.title, i.summary, i.canonical_url, i.published_at, i.image_url AS stored_image, i.body_content AS stored_body,
            coalesce(i.image_url, p.image_url) AS image_url, coalesce(i.body_content, p.body_text) AS body_text, coalesce(p.failed, TRUE) AS failed,
            CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS BIGINT) AS engagement_count, FALSE AS paywalled, FALSE AS duplicate
        FROM fx_items i LEFT JOIN fx_page_metadata p USING (canonical_url) WHERE i.backfilled_at IS NULL""",
    "scored": scored_view("filled"),
    "near": "SELECT '' AS id WHERE FALSE",
    "language": language_view("filled", "body_text"),
    "verdict": verdict_view(),
    "passed": """SELECT f.id, coalesce(CASE WHEN failed THEN stored_image ELSE image_url END, '') <> '' AS image_found,
            len(regexp_extract_all(CASE WHEN failed THEN stored_body ELSE body_text END, '\\S+')) AS body_words,
            round(CASE WHEN failed THEN -1 ELSE v.score END, 6) AS score, CASE WHEN failed THEN 'extraction_failed' ELSE v.reason END AS reason,
            CASE WHEN failed THEN 'extraction_failed' WHEN v.accepted THEN 'kept' ELSE 'hidden' END AS action,
            NOT failed AND stored_image IS NULL AND image_url IS NOT NULL AS image_added,
            NOT failed AND stored_body IS NULL AND body_text IS NOT NULL AS body_added
        FROM filled f JOIN verdict v USING (id)""",
}
BACKFILL_VIEWS = ("fx_items", "fx_page_metadata", *CONTEXT_VIEWS)


def _passed(fx):
    context = gate.source_context(fx.sources(), fx.source_topics(), fx.topic_aliases())
    return reports.backfill_pass(fx.items(), fx.page_metadata(), context, fixtures.now(), lexicon=fixtures.LEXICON)


@query("backfill_pass", with_views("SELECT * FROM passed", *BACKFILL_VIEWS, extra=BACKFILL))
def backfill_pass(fx):
    return _passed(fx).withColumn("score", rounded(F.coalesce("score", F.lit(-1.0)))).withColumn("body_words", F.col("body_words").cast("bigint"))


@query(
    "backfill_report",
    with_views(
        """SELECT count(*) AS processed, count(*) FILTER (image_added) AS images_added, count(*) FILTER (body_added) AS bodies_added,
            count(*) FILTER (action = 'hidden') AS hidden, count(*) FILTER (action = 'extraction_failed') AS extraction_failures FROM passed""",
        *BACKFILL_VIEWS, extra=BACKFILL,
    ),
)
def backfill_report(fx):
    return reports.backfill_report(_passed(fx))


VERDICT_LOG_SQL = with_views(
    f"SELECT url_hash, strftime(day, '%Y-%m-%d') AS day, title, source_id, CAST(score AS DOUBLE) AS score, decision, reason, {sql_stamp('created_at')} AS created_at FROM fx_verdict_log",
    "fx_verdict_log",
)


def _log_rows(log):
    return log.select(
        "url_hash", F.date_format("day", "yyyy-MM-dd").alias("day"), "title", "source_id", F.col("score").cast("double").alias("score"),
        "decision", "reason", stamp("created_at").alias("created_at"),
    )


@query("verdict_log", VERDICT_LOG_SQL)
def verdict_log(fx):
    return _log_rows(state.verdict_log(fx.verdicts()))


SIGNALS_SQL = with_views(
    f"""SELECT item_id, CAST(max(greatest(0, floor(reported))) AS BIGINT) AS engagement_count,
        CASE WHEN bool_or(coalesce(stored_source_id <> source_id, FALSE) AND coalesce(previous <> platform, TRUE)) THEN 2 ELSE 1 END AS source_count,
        arg_max(platform, k) AS platform, {sql_stamp('arg_max(seen_at, k)')} AS collected_at
    FROM (SELECT *, {{'a': seen_at, 'b': hit_id}} AS k, lag(platform) OVER (PARTITION BY item_id ORDER BY seen_at, hit_id) AS previous
        FROM fx_hits WHERE reported IS NOT NULL) GROUP BY item_id""",
    "fx_hits",
)


@query("signals_fold", SIGNALS_SQL)
def signals_fold(fx):
    return state.signals_fold(fx.hits()).withColumn("collected_at", stamp("collected_at"))


READER_STATE_SQL = with_views(
    f"""SELECT user_id, item_id, coalesce(arg_max("read", k) FILTER (coalesce(saved, TRUE) AND "read" IS NOT NULL), FALSE) AS is_read, {sql_stamp('max("at")')} AS saved_at
    FROM (SELECT *, {{'a': "at", 'b': seq}} AS k, max({{'a': "at", 'b': seq}}) FILTER (NOT saved) OVER (PARTITION BY user_id, item_id) AS removed FROM fx_state_events)
    WHERE removed IS NULL OR k > removed GROUP BY user_id, item_id""",
    "fx_state_events",
)


@query("reader_state", READER_STATE_SQL)
def reader_state(fx):
    return state.reader_state(fx.state_events()).withColumn("saved_at", stamp("saved_at"))


WANTED_SQL = "SELECT user_id, name AS topic_name FROM (SELECT DISTINCT user_id FROM events) JOIN fx_topics ON user_id % 3 = 0 AND topic_id = user_id % 4 UNION SELECT DISTINCT user_id, 'Nothing' FROM events WHERE user_id % 3 = 1"


def _wanted(fx):
    users = fx.table("events").select("user_id").distinct()
    named = users.filter("user_id % 3 = 0").withColumn("topic_id", F.col("user_id") % 4).join(fx.topics(), "topic_id")
    unknown = users.filter("user_id % 3 = 1").select("user_id", F.lit("Nothing").alias("topic_name"))
    return named.select("user_id", F.col("name").alias("topic_name")).unionByName(unknown)


@query(
    "replace_topic_selection",
    with_views(
        """SELECT user_id, CAST(topic_id AS BIGINT) AS topic_id FROM wanted JOIN fx_topics ON name = topic_name
        UNION SELECT user_id, topic_id FROM fx_user_topics WHERE user_id NOT IN (SELECT user_id FROM wanted JOIN fx_topics ON name = topic_name)""",
        "fx_topics", "fx_user_topics", extra={"wanted": WANTED_SQL},
    ),
)
def replace_topic_selection(fx):
    selected, _ = state.replace_topic_selection(fx.user_topics(), _wanted(fx), fx.topics())
    return selected


@query(
    "replace_topic_selection_errors",
    with_views("SELECT DISTINCT user_id, 'NO_KNOWN_TOPIC' AS error FROM wanted WHERE topic_name = 'Nothing'", "fx_topics", extra={"wanted": WANTED_SQL}),
)
def replace_topic_errors(fx):
    _, failed = state.replace_topic_selection(fx.user_topics(), _wanted(fx), fx.topics())
    return failed


for _kind, _types in (("feeds", state.FEED_TYPES), ("discovery", state.DISCOVERY_TYPES), ("all", None)):

    def _register(kind=_kind, types=_types):
        wanted = f"source_type IN ({quoted(types)})" if types else "TRUE"
        due = f"coalesce(epoch_us({NOW}) - epoch_us(coalesce(last_success_at, last_fetched_at)) >= coalesce(fetch_interval_minutes, 30) * 60000000, TRUE)"

        @query(f"overdue_sources_{kind}", with_views(f"SELECT source_id, source_type FROM fx_sources WHERE is_active AND {wanted} AND {due}", "fx_sources"))
        def overdue(fx):
            return state.overdue_sources(fx.sources(), kind, fixtures.now()).select("source_id", "source_type")

    _register()


@query(
    "close_stale_runs",
    with_views(
        f"""SELECT run_id, CASE WHEN dead THEN 'failed' ELSE status END AS status, {sql_stamp(f'CASE WHEN dead THEN {NOW} ELSE completed_at END')} AS completed_at,
            CASE WHEN dead THEN 1 ELSE error_count END AS error_count, CASE WHEN dead THEN 'TIMED_OUT' ELSE error_message END AS error_message
        FROM (SELECT *, status = 'running' AND epoch_us({NOW}) - epoch_us(started_at) > 1800000000 AS dead FROM fx_runs)""",
        "fx_runs",
    ),
)
def close_stale_runs(fx):
    closed = state.close_stale_runs(fx.runs(), fixtures.now())
    return closed.select("run_id", "status", stamp("completed_at").alias("completed_at"), "error_count", "error_message")


VALID = f"""client_event_id IS NOT NULL AND content_item_id IS NOT NULL AND type IN ({quoted(state.EVENT_TYPES)})
    AND (dwell_seconds IS NULL OR (dwell_seconds BETWEEN 0 AND 86400 AND dwell_seconds = floor(dwell_seconds)))
    AND (completion_ratio IS NULL OR completion_ratio BETWEEN 0 AND 1)"""


@query(
    "valid_events",
    with_views(f"""SELECT client_event_id, content_item_id, type, round(coalesce(dwell_seconds, -1), 6) AS dwell_seconds,
        round(coalesce(completion_ratio, -1), 6) AS completion_ratio, {sql_stamp('"at"')} AS "at" FROM fx_reader_events WHERE {VALID}""", "fx_reader_events"),
)
def valid_events(fx):
    events = state.valid_events(fx.raw_events())
    return events.select(
        "client_event_id", "content_item_id", "type", rounded(F.coalesce("dwell_seconds", F.lit(-1.0))).alias("dwell_seconds"),
        rounded(F.coalesce("completion_ratio", F.lit(-1.0))).alias("completion_ratio"), stamp("at").alias("at"),
    )


@query("dead_letter_events", with_views(f"SELECT event_id FROM fx_reader_events WHERE NOT coalesce({VALID}, FALSE)", "fx_reader_events"))
def dead_letter_events(fx):
    return state.dead_letters(fx.raw_events()).select("event_id")


WINDOWS_SQL = with_views(
    f"""SELECT strftime(date_trunc('hour', "at"), '%Y-%m-%d %H:%M:%S') AS window_start, content_item_id, type, count(*) AS events
        FROM fx_reader_events WHERE {VALID} GROUP BY ALL""",
    "fx_reader_events",
)


@query("event_windows", WINDOWS_SQL)
def event_windows(fx):
    return state.event_windows(state.valid_events(fx.raw_events())).withColumn("window_start", stamp("window_start"))


QUOTA_SQL = with_views(
    f"""SELECT r.platform, request_id, {sql_stamp('w.start')} AS window_started_at,
        row_number() OVER (PARTITION BY r.platform, w.start ORDER BY asked_at, request_id) <= CASE r.platform WHEN 'github' THEN 40 ELSE 200 END AS granted
    FROM fx_quota_requests r JOIN chain w ON w.platform = r.platform AND r.asked_at >= w.start AND r.asked_at <= w.start + w.span""",
    "fx_quota_requests",
    recursive=True,
    extra={
        "chain": """SELECT platform, min(asked_at) AS start, CASE platform WHEN 'github' THEN INTERVAL 60 MINUTE ELSE INTERVAL 1440 MINUTE END AS span FROM fx_quota_requests GROUP BY platform
            UNION ALL SELECT c.platform, n.start, c.span FROM chain c, LATERAL (SELECT min(asked_at) AS start FROM fx_quota_requests r WHERE r.platform = c.platform AND r.asked_at > c.start + c.span) n WHERE n.start IS NOT NULL""",
    },
)


@query("quota_ledger", QUOTA_SQL)
def quota_ledger(fx):
    decided = quota.quota_ledger(fx.quota_requests())
    return decided.select("platform", "request_id", stamp("window_started_at").alias("window_started_at"), "granted")


# Requests that cost one to five, under limits of a table: each window is walked request by request.
COST_SQL = with_views(
    f"""SELECT platform, request_id, {sql_stamp('start')} AS window_started_at, cost, granted FROM walk WHERE request_id IS NOT NULL""",
    "fx_quota_requests",
    recursive=True,
    extra={
        "asked": "SELECT *, 1 + request_id * 7 % 5 AS cost, CASE platform WHEN 'github' THEN 25 ELSE 60 END AS allowed, CASE platform WHEN 'github' THEN INTERVAL 90 MINUTE ELSE INTERVAL 600 MINUTE END AS span FROM fx_quota_requests WHERE request_id % 3 = 0",
        "chain": """SELECT platform, min(asked_at) AS start, any_value(span) AS span FROM asked GROUP BY platform
            UNION ALL SELECT c.platform, n.start, c.span FROM chain c, LATERAL (SELECT min(asked_at) AS start FROM asked r WHERE r.platform = c.platform AND r.asked_at > c.start + c.span) n WHERE n.start IS NOT NULL""",
        "queue": """SELECT r.platform, c.start, request_id, cost, allowed, row_number() OVER (PARTITION BY r.platform, c.start ORDER BY asked_at, request_id) AS place
            FROM asked r JOIN chain c ON c.platform = r.platform AND r.asked_at >= c.start AND r.asked_at <= c.start + c.span""",
        "walk": """SELECT DISTINCT platform, start, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS cost, FALSE AS granted FROM queue
            UNION ALL SELECT q.platform, q.start, q.place, CASE WHEN w.used + q.cost <= q.allowed THEN w.used + q.cost ELSE w.used END, q.request_id, q.cost, w.used + q.cost <= q.allowed
            FROM walk w JOIN queue q ON q.platform = w.platform AND q.start = w.start AND q.place = w.place + 1""",
    },
)


@query("quota_ledger_costs", COST_SQL)
def quota_ledger_costs(fx):
    asked = fx.quota_requests().filter("request_id % 3 = 0").withColumn("cost", 1 + F.col("request_id") * 7 % 5)
    budgets = quota.budget_table(fx.spark, {"github": (25, 90), "stack_exchange": (60, 600)})
    decided = quota.quota_ledger(asked, budgets=budgets)
    return decided.select("platform", "request_id", stamp("window_started_at").alias("window_started_at"), "cost", "granted")


# Streaming twins: the same rows through Structured Streaming with everything available now.


def _run_folder(fx, name: str) -> str:
    return f"{shared_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


def _finished(started):
    started.awaitTermination()


@query("verdict_log_stream", VERDICT_LOG_SQL)
def verdict_log_stream(fx):
    folder = _run_folder(fx, "verdicts")
    _finished(jobs.verdict_log_stream(StreamFixtures(fx.spark, fx.folder).verdicts(), f"{folder}/rows", f"{folder}/checkpoint"))
    return _log_rows(fx.spark.read.parquet(f"{folder}/rows"))


@query("signals_stream", SIGNALS_SQL)
def signals_stream(fx):
    folder = _run_folder(fx, "signals")
    tables = Snapshots(fx.spark, f"{folder}/tables")
    _finished(jobs.signals_stream(StreamFixtures(fx.spark, fx.folder).hits(), tables, f"{folder}/checkpoint"))
    return state.signals_of(tables.read("signal_summaries")).withColumn("collected_at", stamp("collected_at"))


@query("reader_state_stream", READER_STATE_SQL)
def reader_state_stream(fx):
    folder = _run_folder(fx, "reader-state")
    tables = Snapshots(fx.spark, f"{folder}/tables")
    stream = jobs.reader_state_changes(StreamFixtures(fx.spark, fx.folder).state_events())
    _finished(jobs.write_changes(stream, tables, "saved_items", ["user_id", "item_id"], f"{folder}/checkpoint"))
    latest = tables.read("saved_items").filter("is_saved")
    return latest.select("user_id", "item_id", "is_read", stamp("saved_at").alias("saved_at"))


@query("event_windows_stream", WINDOWS_SQL)
def event_windows_stream(fx):
    folder = _run_folder(fx, "event-windows")
    tables = Snapshots(fx.spark, f"{folder}/tables")
    stream = jobs.event_window_stream(StreamFixtures(fx.spark, fx.folder).raw_events())
    _finished(jobs.write_changes(stream, tables, "event_windows", ["window_start", "content_item_id", "type"], f"{folder}/checkpoint"))
    return tables.read("event_windows").withColumn("window_start", stamp("window_start"))


@query("quota_ledger_stream", QUOTA_SQL)
def quota_ledger_stream(fx):
    folder = _run_folder(fx, "quota")
    _finished(jobs.quota_stream(StreamFixtures(fx.spark, fx.folder).quota_requests(), f"{folder}/rows", f"{folder}/checkpoint"))
    decided = fx.spark.read.parquet(f"{folder}/rows/decisions")
    return decided.select("platform", "request_id", stamp("window_started_at").alias("window_started_at"), "granted")




# The whole ingest pass over RSS payloads; no SQL, since the accepted set depends on the order of each run.


@query("ingest_batch")
def ingest_pass(fx):
    candidates = feeds.normalize_rss(fx.raw_rss())
    stored = fx.stored_titles().select(
        "id", "title", "fetched_at", F.lit(None).cast("string").alias("source_id"), F.sha2("id", 256).alias("url_hash"),
        F.concat(F.lit("https://stored.example.com/"), "id").alias("canonical_url"),
    )
    result = ingest_batch(
        candidates, stored, fx.sources(), fx.source_topics(), fx.topic_aliases(), fixtures.now(), lexicon=fixtures.LEXICON
    )
    return result.runs.select("source_id", "fetched", "inserted", "duplicates", "rejected", "status", "error_message")

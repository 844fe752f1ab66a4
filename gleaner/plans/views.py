"""SQL text of the fixture views, for checking results with another engine."""

from __future__ import annotations

from gleaner.plans import fixtures as fx

NOW = f"TIMESTAMP '{fx.NOW_TEXT}'"
WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def pick(index: str, values) -> str:
    return f"list_extract([{quoted(values)}], ({index}) + 1)"


def mapped(key: str, table: dict) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def minutes_ago(minutes: str) -> str:
    return f"({NOW} - to_minutes(CAST({minutes} AS BIGINT)))"


def hours_ago(hours: str) -> str:
    return f"({NOW} - to_hours(CAST({hours} AS BIGINT)))"


def collapsed(text: str) -> str:
    return f"nullif(trim(regexp_replace({text}, '{WS}+', ' ', 'g')), '')"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def canonical(url: str) -> str:
    """Canonical form of an http(s) URL without percent escapes."""
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    key = "lower(split_part(p, '=', 1))"
    kept = (
        f"list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT (starts_with({key}, 'utm_') "
        f"OR {key} IN ('ref', 'fbclid', 'gclid') OR ({key} = 'source' AND starts_with(lower(split_part(p, '=', 2)), 'rss'))))"
    )
    joined = f"array_to_string(list_sort({kept}), '&')"
    folded = f"regexp_replace('/' || regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')"
    path = f"CASE WHEN {folded} = '/' THEN '/' ELSE regexp_replace({folded}, '/$', '') END"
    return (
        f"(lower(regexp_extract({url}, '^([a-zA-Z]+)://', 1)) || '://' || "
        f"lower(regexp_extract({url}, '^[a-zA-Z]+://([^/?#]*)', 1)) || {path} || "
        f"CASE WHEN coalesce({joined}, '') = '' THEN '' ELSE '?' || {joined} END)"
    )


def dedupe_key(url: str) -> str:
    return f"regexp_replace(regexp_replace({url}, '([?&])source=rss[^&]*(&|$)', '\\1', 'g'), '[?&]+$', '')"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9.+#/-]+')"


def shingles(title: str) -> str:
    w = words(title)
    return (
        f"list_sort(list_distinct(CASE WHEN len({w}) < 2 THEN {w} ELSE "
        f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) END))"
    )


def recency(column: str) -> str:
    hours = f"greatest(0e0, (epoch_us({NOW}) - epoch_us({column})) / 3600000000e0)"
    return f"CASE WHEN {column} IS NULL THEN 0e0 ELSE pow(2e0, -({hours}) / 48e0) END"


def days_old(column: str) -> str:
    return f"((epoch_us({NOW}) - epoch_us({column})) / 86400000000e0)"


N_DOCS = "(SELECT count(*) FROM documents)"
N_PAGES = "(SELECT count(*) FROM pages)"

_TOPIC_VALUES = ", ".join(f"({i}, '{name}')" for i, name in fx.TOPICS)
_ALIAS_VALUES = ", ".join(f"({i}, '{alias}')" for i, alias in fx.TOPIC_ALIASES)

VIEWS: dict[str, tuple[list[str], str]] = {
    "fx_items": ([], f"""
        SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS n, source AS source_id,
            array_to_string(list_slice(regexp_extract_all(text, '[^ \\t\\n\\r]+'), 1, 12), ' ') AS title,
            CASE WHEN doc_id % 11 <> 0 THEN split_part(text, chr(10), 1) END AS summary,
            text AS body_content,
            'https://' || source || '.example.com/' || lang || '/' || doc_id AS canonical_url,
            CASE WHEN doc_id % 3 <> 0 THEN 'https://images.example.com/max/' || (doc_id % 1500) || '/' || doc_id || '.png' END AS image_url,
            CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' WHEN 2 THEN ' Ada Writer ' WHEN 3 THEN 'n/a'
                ELSE 'Writer ' || (doc_id % 13) END AS author,
            CASE WHEN doc_id % 50 <> 0 THEN {hours_ago('(doc_id * 37) % 2400')} END AS published_at,
            coalesce(CASE WHEN doc_id % 50 <> 0 THEN {hours_ago('(doc_id * 37) % 2400')} END, {NOW}) + INTERVAL 1 HOUR AS fetched_at,
            doc_id % 17 = 0 AS is_hidden,
            CASE WHEN doc_id % 4 = 0 THEN {NOW} END AS backfilled_at
        FROM documents"""),
    "fx_links": (["fx_items"], f"""
        SELECT id, n, source_id, CASE WHEN n % 2 = 0 THEN image_url END AS image_url, body_content, fetched_at, published_at, title,
            canonical_url, sha256(canonical_url) AS url_hash
        FROM (SELECT i.id, i.n, i.source_id, i.image_url, i.body_content, i.fetched_at, i.published_at, i.title,
            CASE WHEN n % 97 = 1 THEN 'ftp://files.example.com/' || id
                 WHEN n % 101 = 1 THEN 'https://me:secret@example.com/' || id
                 WHEN n % 5 = 0 AND NOT contains(p.url, '#') THEN p.url || CASE WHEN contains(p.url, '?') THEN '&' ELSE '?' END
                    || 'source=rss----' || (n % 7) || '---4'
                 ELSE p.url END AS canonical_url
            FROM fx_items i JOIN pages p ON p.page_id = i.n % {N_PAGES})"""),
    "fx_keyed": (["fx_links"], f"""
        SELECT *, CASE WHEN starts_with(canonical_url, 'ftp:') THEN 'UNSUPPORTED_SCHEME'
                WHEN contains(canonical_url, '@') THEN 'EMBEDDED_CREDENTIALS' END AS error,
            CASE WHEN NOT starts_with(canonical_url, 'ftp:') AND NOT contains(canonical_url, '@') THEN {canonical('canonical_url')} END AS new_url
        FROM fx_links"""),
    "fx_sources": ([], f"""
        SELECT source_id, k, 'Feed ' || source_id AS name, {pick('k % 11', fx.SOURCE_TYPES)} AS source_type,
            k % 7 <> 6 AS is_active, CASE WHEN k % 5 <> 0 THEN k * 15 END AS fetch_interval_minutes,
            CASE WHEN k % 12 <> 0 THEN {minutes_ago('k * 20')} END AS last_fetched_at,
            CASE WHEN k % 8 = 3 THEN {hours_ago('216')} WHEN k % 6 <> 0 THEN {minutes_ago('k * 13')} END AS last_success_at,
            CASE WHEN k % 9 = 8 THEN 'FETCH_FAILED' END AS last_error,
            CASE WHEN k % 3 <> 0 THEN k + 20 END AS max_article_age_days,
            CASE WHEN k % 10 <> 9 THEN {pick('k % 4', fx.TIERS)} END AS trust_tier
        FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS BIGINT) AS k FROM documents)"""),
    "fx_topics": ([], f"SELECT * FROM (VALUES {_TOPIC_VALUES}) t(topic_id, name)"),
    "fx_topic_aliases": ([], f"SELECT * FROM (VALUES {_ALIAS_VALUES}) t(topic_id, alias)"),
    "fx_source_topics": (["fx_sources"], """
        SELECT source_id, k % 6 AS topic_id FROM fx_sources WHERE k % 6 < 5
        UNION SELECT source_id, (k + 2) % 5 FROM fx_sources WHERE k % 4 = 1"""),
    "fx_item_topics": (["fx_items", "fx_topic_aliases", "fx_source_topics"], """
        SELECT i.id AS item_id, CAST(a.topic_id AS BIGINT) AS topic_id FROM fx_items i JOIN fx_topic_aliases a
            ON contains(lower(i.title || ' ' || coalesce(i.summary, '')), a.alias)
        UNION SELECT i.id, CAST(s.topic_id AS BIGINT) FROM fx_items i JOIN fx_source_topics s USING (source_id)"""),
    "fx_events": ([], f"SELECT *, event_id % {N_DOCS} AS item_n FROM events"),
    "fx_signals": (["fx_events"], """
        SELECT CAST(item_n AS VARCHAR) AS item_id, count(*) AS engagement_count, count(DISTINCT event_type) AS source_count,
            max(event_type) AS platform, max(ts) AS collected_at FROM fx_events GROUP BY 1"""),
    "fx_user_topics": ([], """
        SELECT DISTINCT user_id, user_id % 5 AS topic_id FROM events
        UNION SELECT DISTINCT user_id, (user_id * 3 + 1) % 5 FROM events"""),
    "fx_affinity": ([], """
        SELECT DISTINCT user_id, user_id % 5 AS topic_id, CAST(user_id % 31 - 5 AS DOUBLE) AS affinity FROM events"""),
    "fx_orders": ([], f"""
        SELECT *, CAST(o_orderkey % {N_DOCS} AS VARCHAR) AS item_id, o_custkey % 150 AS user_id FROM orders"""),
    "fx_saved": (["fx_orders"], """
        SELECT user_id, item_id, o_orderstatus = 'F' AS is_read, o_orderdate AS saved_at FROM fx_orders
        QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY o_orderdate, o_orderkey) = 1"""),
    "fx_submissions": (["fx_orders"], """
        SELECT o_orderkey AS submission_id, user_id, item_id,
            CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'completed' END AS status
        FROM fx_orders WHERE o_orderpriority = '1-URGENT'"""),
    "fx_candidates": (["fx_items"], f"""
        SELECT id, n, source_id, n AS position, title,
            CASE WHEN n % 37 = 3 THEN 'Sponsored post: ' || title ELSE summary END AS summary,
            CASE WHEN n % 41 = 3 THEN 'Please subscribe to continue.' WHEN n % 13 <> 5 THEN body_content END AS body_text,
            CASE WHEN n % 29 = 3 THEN 'https://old.reddit.com/r/' || id WHEN n % 31 = 3 THEN 'not a link' ELSE canonical_url END AS canonical_url,
            image_url, author, published_at, fetched_at,
            CASE n % 10 WHEN 0 THEN 'release' WHEN 1 THEN 'video' ELSE 'article' END AS kind,
            CASE WHEN n % 4 <> 0 THEN {pick('n % 6', fx.PLATFORMS)} END AS platform,
            CASE WHEN n % 5 <> 0 THEN (n * 7) % 120 END AS engagement_count,
            n % 19 = 3 AS paywalled, n % 23 = 3 AS duplicate
        FROM fx_items"""),
    "fx_stored_titles": ([], f"""
        SELECT 'p' || page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
            {hours_ago('(page_id * 11) % 1000')} AS fetched_at FROM pages"""),
    "fx_page_metadata": (["fx_items"], """
        SELECT i.canonical_url, 'Page author ' || (n % 5) AS author, 'Page summary ' || n AS summary,
            trim(regexp_replace(regexp_replace(regexp_extract(p.html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS body_text,
            CASE WHEN n % 4 <> 0 THEN 'https://pages.example.com/' || n || '.png' END AS image_url, n % 9 = 0 AS failed
        FROM pages p JOIN fx_items i ON i.n = p.page_id"""),
    "fx_runs": ([], """
        SELECT o_orderkey AS run_id, 'src' || (o_custkey % 23) AS source_id, o_orderdate AS started_at,
            CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_custkey) END AS completed_at,
            CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'running' END AS status,
            o_custkey % 20 AS fetched, o_custkey % 7 AS inserted, o_custkey % 5 AS duplicates, o_custkey % 3 AS rejected,
            o_custkey % 2 AS enriched, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS error_count,
            CASE o_orderstatus WHEN 'F' THEN 'FETCH_FAILED' END AS error_message
        FROM orders"""),
    "fx_fetch_attempts": ([], """
        SELECT url, CASE page_id % 6 WHEN 0 THEN 'HTTP_403' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'socket hang up' END AS error_code FROM pages"""),
    "fx_verdicts": ([], f"""
        SELECT sha256('item-' || user_id) AS url_hash, 'https://example.com/' || user_id AS canonical_url,
            'Story ' || user_id || ' seen ' || event_id AS title, 'src' || (user_id % 23) AS source_id,
            (event_id * 13 % 1001) / 1000e0 AS score, event_id * 13 % 1001 >= 600 AS accepted,
            CASE WHEN event_id * 13 % 1001 >= 600 THEN 'qualified'
                ELSE {pick('event_id % 4', ['stale', 'thin_content', 'non_english', 'below_threshold'])} END AS reason,
            ts AS created_at FROM events"""),
    "fx_verdict_log": (["fx_verdicts"], """
        SELECT url_hash, CAST(created_at AS DATE) AS day, canonical_url, title AS title, source_id,
            round(score, 3) AS score, CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS decision, reason, created_at
        FROM fx_verdicts
        QUALIFY row_number() OVER (PARTITION BY url_hash, CAST(created_at AS DATE) ORDER BY created_at, canonical_url, title, reason) = 1"""),
    "fx_hits": ([], f"""
        SELECT CAST(user_id % 10 AS VARCHAR) AS item_id, event_id AS hit_id, ts AS seen_at,
            {mapped('event_type', fx.EVENT_PLATFORMS)} AS platform,
            CASE WHEN event_id % 9 <> 0 THEN value * 10 - 50 END AS reported,
            'src' || (event_id % 3) AS source_id,
            CASE WHEN user_id % 10 % 6 <> 0 THEN 'src' || (user_id % 10 % 3) END AS stored_source_id
        FROM events"""),
    "fx_state_events": ([], """
        SELECT l_suppkey AS user_id, CAST(l_partkey % 50 AS VARCHAR) AS item_id, l_shipdate AS "at",
            l_orderkey * 100 + l_linenumber AS seq,
            CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS saved,
            CASE l_returnflag WHEN 'N' THEN l_linestatus = 'O' END AS read FROM lineitem"""),
    "fx_reader_events": (["fx_events"], f"""
        SELECT event_id, CASE WHEN event_id % 31 <> 0 THEN 'e' || event_id END AS client_event_id,
            CAST(item_n AS VARCHAR) AS content_item_id, {mapped('event_type', fx.EVENT_NAMES)} AS type,
            CASE WHEN event_id % 50 = 0 THEN -1e0 WHEN event_id % 51 = 0 THEN 1.5e0 WHEN event_id % 3 = 0 THEN floor(value) END AS dwell_seconds,
            CASE WHEN event_id % 4 = 0 THEN value / 100 END AS completion_ratio, date_trunc('second', ts) AS "at"
        FROM fx_events"""),
    "fx_quota_requests": ([], """
        SELECT CASE WHEN event_type IN ('click', 'view') THEN 'github' ELSE 'stack_exchange' END AS platform,
            event_id AS request_id, ts AS asked_at FROM events"""),
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix a query with the views it names, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in (extra or {}).items()]
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body

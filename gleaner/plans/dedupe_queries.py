"""Queries over near-duplicate groups and what their merge moves."""

from pyspark.sql import functions as F

from gleaner.operators import dedupe
from gleaner.plans import fixtures
from gleaner.plans.gate_queries import language_view
from gleaner.plans.registry import query, rounded, stamp
from gleaner.plans.views import NOW, shingles, stamp as sql_stamp, with_views

SHARED = "len(list_intersect(a.s, b.s))"
JACCARD = f"({SHARED} / (len(a.s) + len(b.s) - {SHARED}))"
WITHIN_WEEK = "(a.published_at IS NULL OR b.published_at IS NULL OR abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 604800000000)"

# Every two items compared, editions from gaps between consecutive dates of equal titles.
CUT = {
    "cut": f"SELECT id, published_at, s, md5(array_to_string(s, chr(10))) AS set_id FROM (SELECT id, published_at, {shingles('title')} AS s FROM fx_items) WHERE len(s) > 0",
    "editions": """
        SELECT *, set_id || ':' || CASE WHEN bool_or(published_at IS NULL) OVER (PARTITION BY set_id) THEN 0
            ELSE sum(starts) OVER (PARTITION BY set_id ORDER BY published_at, id ROWS UNBOUNDED PRECEDING) END AS node
        FROM (SELECT *, CASE WHEN epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY set_id ORDER BY published_at, id))
            > 604800000000 THEN 1 ELSE 0 END AS starts FROM cut)""",
    "sets": "SELECT DISTINCT set_id, s FROM cut",
    "alike": f"SELECT a.set_id AS set_a, b.set_id AS set_b, {JACCARD} AS similarity FROM sets a JOIN sets b ON a.set_id < b.set_id AND {SHARED} > 0 AND {JACCARD} > 0.8e0",
}


@query(
    "duplicate_pairs",
    with_views(
        f"""SELECT a.node AS src, b.node AS dst, round(any_value(p.similarity), 6) AS similarity,
            count(DISTINCT a.id) AS items_a, count(DISTINCT b.id) AS items_b
        FROM alike p JOIN editions a ON a.set_id = p.set_a JOIN editions b ON b.set_id = p.set_b
        GROUP BY a.node, b.node HAVING bool_or({WITHIN_WEEK})""",
        "fx_items", extra=CUT,
    ),
)
def duplicate_pairs(fx):
    return dedupe.duplicate_pairs(fx.items()).select("src", "dst", rounded("similarity").alias("similarity"), "items_a", "items_b")


@query(
    "duplicate_members",
    with_views(
        "SELECT node, id, count(*) OVER (PARTITION BY node) AS items FROM editions",
        "fx_items", extra={"cut": CUT["cut"], "editions": CUT["editions"]},
    ),
)
def duplicate_members(fx):
    return dedupe.edition_members(fx.items())


RICHNESS = """CASE WHEN len(regexp_extract_all(coalesce(body_content, ''), '\\S+')) >= 150 THEN 4 WHEN len(regexp_extract_all(coalesce(body_content, ''), '\\S+')) > 0 THEN 2 ELSE 0 END
    + CASE WHEN coalesce(image_url, '') <> '' THEN 2 ELSE 0 END
    + CASE WHEN coalesce(trim(author), '') <> '' AND lower(trim(author)) NOT IN ('unknown author', 'unknown', 'n/a', 'na', 'anonymous', '—', '-', 'undefined', 'null') THEN 1 ELSE 0 END"""

# Closure over item pairs: equal or similar titles within a week of each other.
GROUPED = {
    "cut": CUT["cut"],
    "sets": CUT["sets"],
    "alike": f"SELECT a.set_id AS set_a, b.set_id AS set_b FROM sets a JOIN sets b ON {SHARED} > 0 AND {JACCARD} > 0.8e0",
    "edges": f"SELECT a.id AS src, b.id AS dst FROM alike p JOIN cut a ON a.set_id = p.set_a JOIN cut b ON b.set_id = p.set_b AND a.id <> b.id AND {WITHIN_WEEK}",
    "reach": "SELECT src, src AS dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst",
    "labels": "SELECT src AS id, min(dst) AS label FROM reach GROUP BY src",
    "groups": f"""SELECT l.id, first_value(l.id) OVER (PARTITION BY label ORDER BY {RICHNESS} DESC, published_at NULLS LAST, fetched_at NULLS LAST, l.id) AS keep_id,
        count(*) OVER (PARTITION BY label) AS members FROM labels l JOIN fx_items i USING (id)""",
}


@query("duplicate_groups", with_views("SELECT id, keep_id, members FROM groups", "fx_items", extra=GROUPED, recursive=True))
def duplicate_groups(fx):
    return dedupe.duplicate_groups(fx.items())


def moved(table: str) -> str:
    return f"(SELECT t.* EXCLUDE (item_id), coalesce(g.keep_id, t.item_id) AS item_id, coalesce(g.keep_id <> t.item_id, FALSE) AS from_loser, t.item_id AS origin FROM {table} t LEFT JOIN groups g ON g.id = t.item_id)"


@query(
    "merge_references_topics",
    with_views(f"SELECT DISTINCT item_id, topic_id FROM {moved('fx_item_topics')}", "fx_items", "fx_item_topics", extra=GROUPED, recursive=True),
)
def merge_topics(fx):
    return dedupe.merge_topics(fx.item_topics(), dedupe.duplicate_groups(fx.items()))


@query(
    "merge_references_saves",
    with_views(
        f"SELECT user_id, item_id, bool_or(is_read) AS is_read, {sql_stamp('min(saved_at)')} AS saved_at FROM {moved('fx_saved')} GROUP BY user_id, item_id",
        "fx_items", "fx_saved", extra=GROUPED, recursive=True,
    ),
)
def merge_saves(fx):
    saves = dedupe.merge_saves(fx.saved(), dedupe.duplicate_groups(fx.items()))
    return saves.select("user_id", "item_id", "is_read", stamp("saved_at").alias("saved_at"))


@query(
    "merge_references_submissions",
    with_views(f"SELECT submission_id, user_id, item_id, status FROM {moved('fx_submissions')}", "fx_items", "fx_submissions", extra=GROUPED, recursive=True),
)
def merge_submissions(fx):
    merged = dedupe.merge_submissions(fx.submissions(), dedupe.duplicate_groups(fx.items()))
    return merged.select("submission_id", "user_id", "item_id", "status")


@query(
    "merge_references_signals",
    with_views(
        f"""SELECT item_id, max(engagement_count) AS engagement_count, greatest(1, max(source_count)) AS source_count,
            arg_max(platform, k) AS platform, {sql_stamp('arg_max(collected_at, k)')} AS collected_at
        FROM (SELECT *, {{'a': engagement_count, 'b': NOT from_loser, 'c': origin}} AS k FROM {moved('fx_signals')}) GROUP BY item_id""",
        "fx_items", "fx_signals", extra=GROUPED, recursive=True,
    ),
)
def merge_signals(fx):
    merged = dedupe.merge_signals(fx.signals(), dedupe.duplicate_groups(fx.items()))
    return merged.select("item_id", "engagement_count", F.col("source_count").cast("bigint").alias("source_count"), "platform", stamp("collected_at").alias("collected_at"))


@query(
    "merge_references_items",
    with_views("SELECT id FROM fx_items WHERE id NOT IN (SELECT id FROM groups WHERE id <> keep_id)", "fx_items", extra=GROUPED, recursive=True),
)
def surviving_items(fx):
    return dedupe.surviving_items(fx.items(), dedupe.duplicate_groups(fx.items())).select("id")


LOSERS = {**GROUPED, "losers": "SELECT id AS item_id, keep_id FROM groups WHERE id <> keep_id"}


@query(
    "dedupe_report",
    with_views(
        """SELECT (SELECT count(*) FROM fx_items) AS scanned, (SELECT count(DISTINCT keep_id) FROM losers) AS duplicate_groups,
            (SELECT count(*) FROM losers) AS items_removed,
            (SELECT count(*) FROM (SELECT DISTINCT user_id, keep_id FROM fx_saved JOIN losers USING (item_id))) AS saves_moved,
            (SELECT count(*) FROM fx_submissions JOIN losers USING (item_id)) AS submissions_moved,
            (SELECT count(*) FROM (SELECT DISTINCT keep_id, topic_id FROM fx_item_topics JOIN losers USING (item_id))) AS topic_links_merged""",
        "fx_items", "fx_saved", "fx_submissions", "fx_item_topics", extra=LOSERS, recursive=True,
    ),
)
def dedupe_report(fx):
    groups = dedupe.duplicate_groups(fx.items())
    return dedupe.dedupe_report(fx.items(), groups, fx.item_topics(), fx.saved(), fx.submissions())


SUBMITTED_PAGES = f"""
    SELECT sha256(canonical_url) AS url_hash, 'Page title ' || id AS title, 'Page author' AS author, 'Page summary ' || id AS summary,
        body_content || ' more' AS body_content, 'https://pages.example.com/' || id || '.png' AS image_url, {NOW} AS published_at, n % 150 AS user_id
    FROM (SELECT id, n, body_content, CASE WHEN n % 5 = 0 THEN 'https://other.example.com/' || id ELSE canonical_url END AS canonical_url FROM fx_items WHERE title <> '')"""


def _submitted_pages(fx):
    n = F.col("n")
    url = F.when(n % 5 == 0, F.concat(F.lit("https://other.example.com/"), "id")).otherwise(F.col("canonical_url"))
    return fx.items().filter("title <> ''").select(
        F.sha2(url, 256).alias("url_hash"),
        F.concat(F.lit("Page title "), "id").alias("title"),
        F.lit("Page author").alias("author"),
        F.concat(F.lit("Page summary "), "id").alias("summary"),
        F.concat("body_content", F.lit(" more")).alias("body_content"),
        F.concat(F.lit("https://pages.example.com/"), "id", F.lit(".png")).alias("image_url"),
        fixtures.now().alias("published_at"),
        (n % 150).alias("user_id"),
    )


@query(
    "merge_submission",
    with_views(
        f"""SELECT coalesce(s.url_hash, p.url_hash) AS url_hash, s.id, coalesce(s.title, p.title) AS title, coalesce(s.author, p.author) AS author,
            sha256(coalesce(s.summary, p.summary)) AS summary_hash, coalesce(s.image_url, p.image_url) AS image_url,
            {sql_stamp('coalesce(s.published_at, p.published_at)')} AS published_at,
            length(CASE WHEN length(coalesce(p.body_content, '')) > length(coalesce(s.body_content, '')) THEN p.body_content ELSE s.body_content END) AS body_chars,
            coalesce(p.user_id, -1) AS saved_for
        FROM (SELECT *, sha256(canonical_url) AS url_hash FROM fx_items) s FULL OUTER JOIN submitted p ON s.url_hash = p.url_hash""",
        "fx_items", extra={"submitted": SUBMITTED_PAGES},
    ),
)
def merge_submission(fx):
    stored = fx.items().withColumn("url_hash", F.sha2("canonical_url", 256))
    merged = dedupe.merge_submission(stored, _submitted_pages(fx))
    return merged.select(
        "url_hash", "id", "title", "author", F.sha2("summary", 256).alias("summary_hash"), "image_url",
        stamp("published_at").alias("published_at"), F.length("body_content").cast("bigint").alias("body_chars"),
        F.coalesce("saved_for", F.lit(-1)).alias("saved_for"),
    )


@query(
    "language_purge_plan",
    with_views(
        f"""SELECT i.id, CASE WHEN i.id IN (SELECT item_id FROM fx_submissions) THEN 'reader_submission'
            WHEN i.id IN (SELECT item_id FROM fx_saved) THEN 'saved_by_reader' ELSE 'remove' END AS action
        FROM fx_items i JOIN language l USING (id) WHERE l.is_non_english AND i.fetched_at >= {NOW} - INTERVAL 90 DAY""",
        "fx_items", "fx_saved", "fx_submissions", extra={"language": language_view("fx_items", "body_content")},
    ),
)
def language_purge_plan(fx):
    return dedupe.language_purge_plan(fx.items(), fx.saved(), fx.submissions(), fixtures.now(), lexicon=fixtures.LEXICON)

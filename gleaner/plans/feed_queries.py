"""Queries of topics, ranking, feed assembly and key points."""

from pyspark.sql import functions as F

from gleaner.operators import audience, feed, summary, topics
from gleaner.plans import fixtures
from gleaner.plans.gate_queries import language_view
from gleaner.plans.registry import joined, query, rounded, stamp, text
from gleaner.plans.views import NOW, recency, stamp as sql_stamp, with_views

def matches_view(source: str) -> str:
    """The three best topics of each row of a view."""
    return f"""
    SELECT id, topic_id, hits, least(1e0, 0.55e0 + hits * 0.15e0) AS confidence FROM (
        SELECT i.id, CAST(a.topic_id AS BIGINT) AS topic_id, count(*) AS hits
        FROM {source} i JOIN fx_topic_aliases a ON contains(lower(i.title || ' ' || coalesce(i.summary, '') || ' ' || coalesce(i.body_content, '')), a.alias)
        GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, topic_id) <= 3"""


MATCHES = matches_view("fx_items")


@query("classify", with_views("SELECT id, topic_id, hits, round(confidence, 6) AS confidence FROM matches", "fx_items", "fx_topic_aliases", extra={"matches": MATCHES}))
def classify(fx):
    found = topics.classify(fx.items(), fx.topic_aliases())
    return found.select("id", "topic_id", F.col("hits").cast("bigint").alias("hits"), rounded("confidence").alias("confidence"))


@query("classify_by_join", with_views("SELECT id, topic_id, hits, round(confidence, 6) AS confidence FROM matches", "fx_items", "fx_topic_aliases", extra={"matches": MATCHES}))
def classify_by_join(fx):
    """As for a dictionary too large for the rows."""
    found = topics.classify(fx.items(), fx.topic_aliases(), inline_bytes=0)
    return found.select("id", "topic_id", F.col("hits").cast("bigint").alias("hits"), rounded("confidence").alias("confidence"))


@query(
    "link_topics",
    with_views(
        """SELECT item_id, topic_id FROM (SELECT id AS item_id, topic_id FROM matches
            UNION SELECT i.id, CAST(s.topic_id AS BIGINT) FROM fx_items i JOIN fx_source_topics s USING (source_id))""",
        "fx_items", "fx_topic_aliases", "fx_source_topics", extra={"matches": MATCHES},
    ),
)
def link_topics(fx):
    return topics.link_topics(fx.items(), fx.source_topics(), topics.classify(fx.items(), fx.topic_aliases()))


@query(
    "link_topics_new_only",
    with_views(
        """SELECT id AS item_id, topic_id FROM matches EXCEPT SELECT item_id, topic_id FROM fx_item_topics""",
        "fx_items", "fx_topic_aliases", "fx_item_topics", extra={"matches": MATCHES},
    ),
)
def link_topics_new_only(fx):
    return topics.link_topics(fx.items(), None, topics.classify(fx.items(), fx.topic_aliases()), fx.item_topics())


def leading_view(source: str, second: str) -> str:
    count = "CAST((length({0}) - length(replace({0}, a.alias, ''))) / length(a.alias) AS BIGINT)"
    title, teaser = count.format("lower(i.title)"), count.format(f"lower(coalesce(i.{second}, ''))")
    return f"""
        SELECT id, list_sort(list(topic_id) FILTER (weight = best AND best > 0)) AS led_by, max(best) AS weight FROM (
            SELECT *, max(weight) OVER (PARTITION BY id) AS best FROM (
                SELECT i.id, CAST(a.topic_id AS BIGINT) AS topic_id, sum(3 * {title} + {teaser}) AS weight
                FROM {source} i, fx_topic_aliases a GROUP BY 1, 2)) GROUP BY id"""


@query(
    "leading_topics",
    with_views(
        "SELECT id, coalesce(array_to_string(led_by, '|'), '') AS leading_topics, CAST(weight AS BIGINT) AS leading_weight FROM lead",
        "fx_items", "fx_topic_aliases", extra={"lead": leading_view("fx_items", "summary")},
    ),
)
def leading_topics(fx):
    led = topics.leading_topics(fx.items(), fx.topic_aliases())
    return led.select("id", joined("leading_topics").alias("leading_topics"), F.col("leading_weight").cast("bigint").alias("leading_weight"))


@query(
    "leading_topics_by_join",
    with_views(
        "SELECT id, coalesce(array_to_string(led_by, '|'), '') AS leading_topics, CAST(weight AS BIGINT) AS leading_weight FROM lead",
        "fx_items", "fx_topic_aliases", extra={"lead": leading_view("fx_items", "summary")},
    ),
)
def leading_topics_by_join(fx):
    led = topics.leading_topics(fx.items(), fx.topic_aliases(), inline_bytes=0)
    return led.select("id", joined("leading_topics").alias("leading_topics"), F.col("leading_weight").cast("bigint").alias("leading_weight"))


CARDS = f"""
    SELECT i.id, i.title, coalesce(i.summary, '{feed.DEFAULT_EXCERPT}') AS excerpt, i.canonical_url AS url,
        coalesce(s.name, lower(regexp_extract(i.canonical_url, '^[a-z]+://([^/?#]*)', 1))) AS source,
        CASE WHEN s.trust_tier IN ('official', 'community', 'probationary', 'unknown') THEN s.trust_tier ELSE 'official' END AS trust,
        CASE WHEN coalesce(trim(i.author), '') <> '' AND lower(trim(i.author)) NOT IN ('unknown author', 'unknown', 'n/a', 'na', 'anonymous', '—', '-', 'undefined', 'null') THEN i.author END AS author,
        i.published_at, i.image_url, coalesce(g.engagement_count, 0) AS engagement_count, coalesce(g.source_count, 1) AS source_count,
        CASE WHEN trim(i.body_content) <> '' THEN len(regexp_split_to_array(trim(i.body_content), '\\s+')) END AS word_count,
        coalesce(t.topics, []) AS topics
    FROM fx_items i LEFT JOIN fx_sources s USING (source_id) LEFT JOIN fx_signals g ON g.item_id = i.id
    LEFT JOIN (SELECT item_id, list_sort(list(topic_id)) AS topics FROM fx_item_topics GROUP BY 1) t ON t.item_id = i.id"""
CARD_VIEWS = ("fx_items", "fx_sources", "fx_signals", "fx_item_topics")


def _cards(fx):
    return feed.feed_cards(fx.items(), fx.sources(), fx.item_topics(), fx.signals())


CARD_COLUMNS = f"""c.id, c.title, md5(c.excerpt) AS excerpt_hash, c.url, c.source, c.trust, c.author, {sql_stamp('c.published_at')} AS published_at,
    c.image_url, c.engagement_count, c.source_count, CAST(c.word_count AS VARCHAR) AS word_count, array_to_string(c.topics, '|') AS topics"""


def _card_rows(cards):
    return cards.select(
        "id", "title", F.md5("excerpt").alias("excerpt_hash"), "url", "source", "trust", "author", stamp("published_at").alias("published_at"),
        "image_url", "engagement_count", "source_count", text("word_count").alias("word_count"), joined("topics").alias("topics"),
    )


@query(
    "feed_cards",
    with_views(
        f"SELECT {CARD_COLUMNS}, CASE WHEN len(c.topics) > 0 THEN 'Matches ' || t.name ELSE 'Technology source' END || '|From a tracked source' AS explanation FROM cards c LEFT JOIN fx_topics t ON t.topic_id = c.topics[1]",
        *CARD_VIEWS, "fx_topics", extra={"cards": CARDS},
    ),
)
def feed_cards(fx):
    cards = _cards(fx).withColumn("names", feed.topic_names(fx.topics()))
    shown = _card_rows(cards.withColumn("id", F.col("id")))
    reasons = cards.select("id", F.array_join(feed.explanation(F.col("topics"), F.col("names")), "|").alias("explanation"))
    return shown.join(reasons, "id")


@query("search_feed", with_views(f"SELECT {CARD_COLUMNS} FROM cards c WHERE contains(lower(title || ' ' || excerpt || ' ' || coalesce(author, '') || ' ' || source), 'writer 3')", *CARD_VIEWS, extra={"cards": CARDS}))
def search_feed(fx):
    return _card_rows(feed.search_feed(_cards(fx), "  WRITER 3 "))


def eligible_view(days: int, view: str) -> str:
    keep_saved = "FALSE" if view == "for-you" else "TRUE"
    return f"""
        SELECT e.user_id, e.item_id AS id, s.user_id IS NOT NULL AS saved, coalesce(s.is_read, FALSE) AS read
        FROM (SELECT DISTINCT u.user_id, t.item_id FROM fx_item_topics t JOIN fx_user_topics u USING (topic_id)
                JOIN fx_items i ON i.id = t.item_id WHERE i.published_at >= {NOW} - INTERVAL {days} DAY
              UNION SELECT user_id, item_id FROM fx_saved) e
        JOIN fx_items i ON i.id = e.item_id JOIN language l ON l.id = e.item_id
        LEFT JOIN fx_saved s ON s.user_id = e.user_id AND s.item_id = e.item_id
        WHERE NOT EXISTS (SELECT 1 FROM fx_submissions b WHERE b.user_id = e.user_id AND b.item_id = e.item_id AND b.status = 'completed')
            AND (NOT l.is_non_english OR s.user_id IS NOT NULL) AND ({keep_saved} OR s.user_id IS NULL)
            AND (s.user_id IS NOT NULL OR (NOT i.is_hidden AND coalesce(i.published_at >= {NOW} - INTERVAL {days} DAY, FALSE)))"""


FEED_VIEWS = ("fx_items", "fx_item_topics", "fx_user_topics", "fx_saved", "fx_submissions", "fx_sources", "fx_signals", "fx_topic_aliases", "fx_affinity")


def eligible_parts(view: str, days: int) -> dict[str, str]:
    return {"language": language_view("fx_items", "NULL"), "eligible": eligible_view(days, view)}


def _eligible(fx, view, query_text=""):
    return audience.feed_eligible(
        fx.listed_items(), fx.item_topics(), fx.user_topics(), fx.saved(), fx.submissions(), view, fixtures.now(), query_text, lexicon=fixtures.LEXICON
    )


for _view, _days in (("for-you", 3), ("trending", 365)):

    def _register(view=_view, days=_days):
        name = "feed_eligible_" + view.replace("-", "_")

        @query(name, with_views("SELECT user_id, id, saved, read FROM eligible", *FEED_VIEWS, extra=eligible_parts(view, days)))
        def feed_eligible(fx):
            return _eligible(fx, view)

    _register()


def scored_parts(view: str, days: int, search: str = "") -> dict[str, str]:
    found = f"WHERE contains(lower(c.title || ' ' || c.excerpt || ' ' || coalesce(c.author, '') || ' ' || c.source), '{search}')" if search else ""
    hash_sql = "list_reduce(list_transform(string_split(c.id, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda h, x: (h * 31 + x) % 4294967296, 0::BIGINT)"
    clamp = "list_sum(list_transform(topics, lambda t: least(1e0, greatest(0e0, (coalesce(list_extract(map_extract(affinity, t), 1), 0e0) + 5e0) / 25e0))))"
    base = "((((((0e0 + affinity_term * 0.38e0) + interest * 0.22e0) + recency * 0.2e0) + engagement * 0.12e0) + diversity * 0.06e0) + exploration * 0.02e0)"
    trend = "((((0e0 + recency * 0.4e0) + engagement * 0.35e0) + diversity * 0.15e0) + breadth * 0.1e0)"
    return {
        **eligible_parts(view, days),
        "cards": CARDS,
        "lead": leading_view("cards", "excerpt"),
        "readers": """SELECT user_id, f.followed, a.affinity FROM (SELECT user_id, list(topic_id) AS followed FROM fx_user_topics GROUP BY 1) f
            JOIN (SELECT user_id, map(list(topic_id), list(affinity)) AS affinity FROM fx_affinity GROUP BY 1) a USING (user_id)""",
        "pairs": f"""SELECT e.user_id, e.id, e.saved, c.published_at, c.topics, c.trust, r.followed, r.affinity, {recency('c.published_at')} AS recency,
                least(1e0, greatest(0e0, log10(c.engagement_count + 1e0) / 5e0)) AS engagement, least(c.source_count / 5e0, 1e0) AS diversity,
                least(len(c.topics) / 3e0, 1e0) AS breadth, ({hash_sql} % 1000) / 1000e0 AS exploration,
                CASE c.trust WHEN 'official' THEN 1e0 WHEN 'community' THEN 0.85e0 WHEN 'probationary' THEN 0.7e0 ELSE 0.6e0 END AS trust_factor
            FROM eligible e JOIN (SELECT * FROM cards c {found}) c USING (id) JOIN lead l USING (id) JOIN readers r USING (user_id)
            WHERE e.saved OR list_has_any(CASE WHEN len(coalesce(l.led_by, [])) > 0 THEN l.led_by ELSE c.topics END, r.followed)""",
        "terms": f"""SELECT *, CASE WHEN len(topics) > 0 THEN len(list_intersect(topics, followed)) / len(topics) ELSE 0e0 END AS interest,
            CASE WHEN len(topics) > 0 THEN {clamp} / len(topics) ELSE 0e0 END AS affinity_term FROM pairs""",
        "scored": f"""SELECT *, round({base} * trust_factor, 12) AS for_you_score,
            CASE WHEN published_at IS NULL THEN -1e0 ELSE round({trend} * trust_factor, 12) END AS trending_score FROM terms""",
    }


def _facts(fx, search=""):
    return audience.item_facts(
        fx.listed_items(), fx.sources(), fx.item_topics(), fx.signals(), fx.topic_aliases(), fixtures.now(), search, lexicon=fixtures.LEXICON
    )


def _scored(fx, view, shaped, affinity=None):
    readers = feed.readers(fx.user_topics(), affinity)
    return audience.scored_lists(_facts(fx), readers, fx.saved(), fx.submissions(), view, fixtures.now(), shaped=shaped)


def _page(fx, view, search="", cursor=0):
    readers = feed.readers(fx.user_topics(), fx.affinity())
    return audience.first_places(_facts(fx, search), readers, fx.saved(), fx.submissions(), view, fixtures.now(), cursor, query=search)


@query(
    "feed_scores",
    with_views(
        """SELECT user_id, id, round(recency, 6) AS recency, round(interest, 6) AS interest, round(affinity_term, 6) AS affinity,
            round(engagement, 6) AS engagement, round(diversity, 6) AS diversity, round(exploration, 6) AS exploration,
            round(for_you_score, 6) AS for_you_score, round(trending_score, 6) AS trending_score FROM scored""",
        *FEED_VIEWS, extra=scored_parts("trending", 365),
    ),
)
def feed_scores(fx):
    names = ["recency", "interest", "affinity", "engagement", "diversity", "exploration", "for_you_score", "trending_score"]
    scored = _scored(fx, "trending", {"id": F.col("id"), **{name: rounded(name) for name in names}}, fx.affinity())
    return scored.select("user_id", "id", *names)


@query(
    "match_followed",
    with_views(
        """SELECT user_id, id, array_to_string(list_concat(list_filter(topics, lambda t: list_contains(followed, t)),
            list_filter(topics, lambda t: NOT list_contains(followed, t))), '|') AS topics FROM pairs WHERE NOT saved""",
        *FEED_VIEWS, extra=scored_parts("for-you", 3),
    ),
)
def match_followed(fx):
    followed_first = {"id": F.col("id"), "topics": joined("shown_topics")}
    return _scored(fx, "for-you", followed_first).select("user_id", "id", "topics")


def ranked_sql(order: str, where: str = "TRUE") -> str:
    return f"SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY {order}, id) AS position FROM scored WHERE {where}"


RANKINGS = {
    "rank_for_you": ("for-you", 3, "for_you_score DESC", "TRUE"),
    "rank_trending": ("trending", 365, "trending_score DESC", "published_at IS NOT NULL"),
    "rank_latest": ("latest", 365, "published_at DESC NULLS LAST", "TRUE"),
}
for _name, _spec in RANKINGS.items():

    def _register_rank(name=_name, spec=_spec):
        view, days, order, where = spec

        @query(name, with_views(ranked_sql(order, where), *FEED_VIEWS, extra=scored_parts(view, days)))
        def ranked(fx):
            readers = feed.readers(fx.user_topics(), fx.affinity())
            return audience.ranked_lists(_facts(fx), readers, fx.saved(), fx.submissions(), view, fixtures.now())

    _register_rank()


@query(
    "page_feed",
    with_views(
        f"""SELECT user_id, id, position, total, CAST(CASE WHEN total > 100 THEN 100 END AS VARCHAR) AS next_cursor
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM ({ranked_sql('trending_score DESC', 'published_at IS NOT NULL')}))
        WHERE position > 50 AND position <= 100""",
        *FEED_VIEWS, extra=scored_parts("trending", 365),
    ),
)
def page_feed(fx):
    page = _page(fx, "trending", cursor=50)
    return page.select("user_id", "id", F.col("position").cast("bigint").alias("position"), "total", text("next_cursor").alias("next_cursor"))


@query(
    "page_latest",
    with_views(
        f"""SELECT user_id, id, position, total FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM ({ranked_sql('published_at DESC NULLS LAST')}))
        WHERE position <= 50""",
        *FEED_VIEWS, extra=scored_parts("latest", 365),
    ),
)
def page_latest(fx):
    page = _page(fx, "latest")
    return page.select("user_id", "id", F.col("position").cast("bigint").alias("position"), "total")


@query(
    "feed_search_page",
    with_views(f"SELECT * FROM ({ranked_sql('for_you_score DESC')}) WHERE position <= 50", *FEED_VIEWS, extra=scored_parts("for-you", 365, "writer")),
)
def feed_search_page(fx):
    page = _page(fx, "for-you", "Writer")
    return page.select("user_id", "id", F.col("position").cast("bigint").alias("position"))


for _tab, _word in (("links", "IN"), ("posts", "NOT IN")):

    def _register_tab(tab=_tab, word=_word):
        sql = f"SELECT user_id, item_id, is_read, {sql_stamp('saved_at')} AS saved_at FROM fx_saved WHERE (user_id, item_id) {word} (SELECT (user_id, item_id) FROM fx_submissions WHERE status = 'completed')"

        @query(f"saved_library_{tab}", with_views(sql, "fx_saved", "fx_submissions"))
        def library(fx):
            rows = feed.saved_library(fx.saved(), fx.submissions(), tab)
            return rows.select("user_id", "item_id", "is_read", stamp("saved_at").alias("saved_at"))

    _register_tab()


STOP = ", ".join(f"'{w}'" for w in summary.STOPWORDS)
FURNITURE = " OR ".join(f"contains(lower(sentence), '{p}')" for p in summary.BOILERPLATE)


def points_parts(source: str, most: int, aliases: str = "[]") -> dict[str, str]:
    marked = "regexp_replace(regexp_replace(regexp_replace(body, '\\s+', ' ', 'g'), '([.!?])\\s+([A-Z0-9\"''“])', '\\1' || chr(1) || '\\2', 'g'), '([.!?])([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g')"
    word = "[a-z0-9][a-z0-9''.+#-]*"
    return {
        "split": f"SELECT id, aliases, list_filter(list_transform(string_split({marked}, chr(1)), lambda p: trim(p)), lambda p: p <> '') AS ss FROM (SELECT id, body_content AS body, {aliases} AS aliases FROM {source})",
        "sentences": "SELECT id, aliases, len(ss) AS total, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx FROM split",
        "usable": f"""SELECT *, regexp_extract_all(lower(sentence), '{word}') AS ws FROM sentences
            WHERE len(regexp_extract_all(lower(sentence), '{word}')) BETWEEN 8 AND 60 AND NOT ({FURNITURE})
                AND regexp_matches(sentence, '[.!?]["''”’]?$')
                AND NOT regexp_matches(regexp_replace(sentence, '(?i)\\d+(st|nd|rd|th|s)', '', 'g'), '(?i)[a-z]\\d|\\d[a-z]{{3,}}')""",
        "uses": f"SELECT id, idx, w FROM (SELECT id, idx, unnest(ws) AS w FROM usable) WHERE w NOT IN ({STOP}) AND length(w) >= 3",
        "tf": "SELECT id, w, count(*) AS f FROM uses GROUP BY 1, 2",
        "peaks": "SELECT id, max(f) AS peak FROM tf GROUP BY 1",
        "info": "SELECT id, idx, avg(f / peak) AS info FROM (SELECT DISTINCT id, idx, w FROM uses) JOIN tf USING (id, w) JOIN peaks USING (id) GROUP BY 1, 2",
        "rated": """SELECT u.id, u.idx, u.sentence, round(coalesce(i.info, 0e0) * 0.4e0 + (1e0 - u.idx / u.total) * 0.3e0
                + CASE WHEN len(list_filter(u.aliases, lambda a: contains(lower(u.sentence), lower(a)))) > 0 THEN 1 ELSE 0 END * 0.2e0
                + CASE WHEN regexp_matches(u.sentence, '[0-9]') THEN 1 ELSE 0 END * 0.1e0, 9) AS score
            FROM usable u LEFT JOIN info i USING (id, idx)""",
        "points": f"SELECT id, count(*) AS n, string_agg(sentence, chr(10) ORDER BY idx) AS points FROM (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) <= {most}) GROUP BY id",
    }


@query("key_points", with_views("SELECT id, points FROM points", "fx_items", extra=points_parts("fx_items", 4)))
def key_points(fx):
    return summary.key_points(fx.items()).select("id", F.array_join("points", "\n").alias("points"))


@query(
    "card_key_points",
    with_views(
        "SELECT id, points FROM points WHERE n >= 3",
        *FEED_VIEWS, "fx_topics",
        extra={
            **scored_parts("for-you", 3),
            "page": f"SELECT DISTINCT id FROM ({ranked_sql('for_you_score DESC')}) WHERE position <= 50",
            "named": "SELECT i.id, i.body_content, coalesce(t.names, []) AS names FROM fx_items i LEFT JOIN (SELECT item_id, list(name) AS names FROM fx_item_topics JOIN fx_topics USING (topic_id) GROUP BY 1) t ON t.item_id = i.id WHERE i.id IN (SELECT id FROM page)",
            **points_parts("named", 5, "names"),
        },
    ),
)
def card_key_points(fx):
    page = _page(fx, "for-you")
    names = fx.item_topics().join(fx.topics(), "topic_id").groupBy(F.col("item_id").alias("id")).agg(F.collect_list("name").alias("aliases"))
    return summary.card_key_points(page, fx.items(), names).select("id", F.array_join("points", "\n").alias("points"))

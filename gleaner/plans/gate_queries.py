"""Queries of the qualification gate."""

from pyspark.sql import functions as F

from gleaner.functions.language import (
    ACCENTED,
    ENGLISH_FUNCTION_WORDS,
    ENGLISH_STOPWORDS,
    LATIN,
    NON_LATIN,
)
from gleaner.operators import gate
from gleaner.operators.ranking import positions
from gleaner.operators.skew import checked_join
from gleaner.plans import fixtures
from gleaner.plans.registry import joined, query, rounded, stamp
from gleaner.plans.views import NOW, WS, days_old, quoted, recency, shingles, stamp as sql_stamp, with_views, words


def number(value: float) -> str:
    return f"{value!r}e0"


def table_case(key: str, table: dict, default: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}e0" for k, v in table.items()) + f" ELSE {float(default)!r}e0 END"


def any_phrase(text_sql: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text_sql}, '{p}')" for p in phrases) + ")"


FRESH = f"""
    SELECT c.*, row_number() OVER (PARTITION BY source_id ORDER BY position, id) AS place
    FROM fx_candidates c JOIN fx_sources s USING (source_id)
    WHERE c.published_at >= {NOW} - to_days(CAST(coalesce(s.max_article_age_days, 30) AS INTEGER))
"""


@query("fresh_candidates", with_views("SELECT id, source_id, place FROM fresh", "fx_candidates", "fx_sources", extra={"fresh": FRESH}))
def fresh_candidates(fx):
    fresh = gate.fresh_candidates(fx.candidates(), fx.sources(), fixtures.now()).select("id", "source_id", "position")
    return positions(fresh, "source_id", [F.col("position").asc(), F.col("id").asc()], "place").select("id", "source_id", "place")


@query(
    "fresh_candidates_first",
    with_views(f"SELECT id, source_id FROM fresh WHERE place <= {gate.CANDIDATES_PER_SOURCE}", "fx_candidates", "fx_sources", extra={"fresh": FRESH}),
)
def fresh_candidates_first(fx):
    first = gate.fresh_candidates(fx.candidates(), fx.sources(), fixtures.now(), gate.CANDIDATES_PER_SOURCE)
    return first.select("id", "source_id")


CONTEXT = """
    SELECT s.source_id, coalesce(d.aliases, (SELECT list_sort(list(DISTINCT lower(alias))) FROM fx_topic_aliases)) AS aliases,
        CASE WHEN s.trust_tier IN ('official', 'community', 'probationary', 'unknown') THEN s.trust_tier ELSE 'unknown' END AS trust,
        d.topic_ids, CASE WHEN d.source_id IS NULL AND coalesce(s.trust_tier, 'official') <> 'official' THEN 'SOURCE_TOPICS_MISSING' END AS error
    FROM fx_sources s LEFT JOIN (
        SELECT source_id, list_sort(list(DISTINCT lower(alias))) AS aliases, list_sort(list(DISTINCT topic_id)) AS topic_ids
        FROM fx_source_topics JOIN fx_topic_aliases USING (topic_id) GROUP BY source_id) d USING (source_id)"""
CONTEXT_VIEWS = ("fx_sources", "fx_source_topics", "fx_topic_aliases")


@query(
    "source_context",
    with_views("SELECT source_id, array_to_string(aliases, '|') AS aliases, trust, coalesce(array_to_string(topic_ids, '|'), '') AS topic_ids, error FROM context", *CONTEXT_VIEWS, extra={"context": CONTEXT}),
)
def source_context(fx):
    context = gate.source_context(fx.sources(), fx.source_topics(), fx.topic_aliases())
    return context.select("source_id", joined("aliases").alias("aliases"), "trust", joined("topic_ids").alias("topic_ids"), "error")


ENRICHED = f"""
    SELECT c.id, c.source_id, c.title, u AS enriched,
        CASE WHEN u THEN coalesce(c.author, p.author) ELSE c.author END AS author,
        CASE WHEN u THEN coalesce(c.summary, p.summary) ELSE c.summary END AS summary,
        CASE WHEN u AND coalesce(len({words('p.body_text')}), 0) > coalesce(len({words('c.body_text')}), 0) THEN p.body_text ELSE c.body_text END AS body_text,
        CASE WHEN u THEN coalesce(c.image_url, p.image_url) ELSE c.image_url END AS image_url
    FROM (SELECT *, coalesce(image_url, '') = '' OR coalesce(len({words('body_text')}), 0) < 400 AS wanted FROM fx_candidates) c
    LEFT JOIN fx_page_metadata p USING (canonical_url),
    LATERAL (SELECT c.wanted AND p.canonical_url IS NOT NULL AS u)"""


@query(
    "enrich_from_pages",
    with_views("SELECT id, enriched, author, summary, coalesce(length(body_text), -1) AS body_chars, sha256(body_text) AS body_hash, image_url FROM enriched",
               "fx_candidates", "fx_page_metadata", extra={"enriched": ENRICHED}),
)
def enrich_from_pages(fx):
    done = gate.enrich_from_pages(fx.candidates(), fx.page_metadata())
    return done.select(
        "id", "enriched", "author", "summary",
        F.coalesce(F.length("body_text"), F.lit(-1)).alias("body_chars"), F.sha2("body_text", 256).alias("body_hash"), "image_url",
    )


SITE = "regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*:/*([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', '')"
AGGREGATOR = "(" + SITE.format("canonical_url") + " = '' OR " + " OR ".join(
    f"{SITE.format('canonical_url')} = '{d}' OR ends_with({SITE.format('canonical_url')}, '.{d}')" for d in gate.AGGREGATOR_DOMAINS) + ")"
SPAM = any_phrase("lower(title || ' ' || coalesce(summary, ''))", gate.SPAM_MARKERS)
PAYWALL_TEXT = "lower(coalesce(body_text, summary, ''))"
PAYWALLED = (
    "((paywalled AND coalesce(summary, '') = '' AND coalesce(body_text, '') = '') OR "
    f"({any_phrase(PAYWALL_TEXT, gate.PAYWALL_MARKERS)} AND length({PAYWALL_TEXT}) < 400))"
)


@query("reject_aggregators", with_views(f"SELECT id, canonical_url FROM fx_candidates WHERE {AGGREGATOR}", "fx_candidates"))
def reject_aggregators(fx):
    return gate.reject_aggregators(fx.candidates()).select("id", "canonical_url")


@query(
    "reject_markers",
    with_views(f"SELECT id, CASE WHEN {SPAM} THEN 'spam_markers' ELSE 'paywalled_without_summary' END AS reason FROM fx_candidates WHERE {SPAM} OR {PAYWALLED}", "fx_candidates"),
)
def reject_markers(fx):
    return gate.reject_markers(fx.candidates()).select("id", "reason")


RECENT = f"SELECT id, title, fetched_at FROM {{0}} WHERE fetched_at >= {NOW} - INTERVAL 30 DAY"


@query("recent_titles", with_views(f"SELECT id, title, {sql_stamp('fetched_at')} AS fetched_at FROM ({RECENT.format('fx_items')})", "fx_items"))
def recent_titles(fx):
    return gate.recent_titles(fx.items(), fixtures.now()).select("id", "title", stamp("fetched_at").alias("fetched_at"))


def near_sql(candidates: str, titles: str) -> str:
    """ids of candidates near-duplicating a title, by comparing every two shingle sets."""
    return f"""
        SELECT DISTINCT c.id FROM (SELECT id, {shingles('title')} AS s FROM {candidates}) c
        JOIN (SELECT DISTINCT {shingles('title')} AS s FROM {titles}) t
        ON len(list_intersect(c.s, t.s)) > 0 AND len(list_intersect(c.s, t.s)) / (len(c.s) + len(t.s) - len(list_intersect(c.s, t.s))) > 0.8e0"""


NEAR = {"recent": RECENT.format("fx_stored_titles"), "near": near_sql("fx_candidates", "recent")}


@query("near_duplicate_titles", with_views("SELECT id FROM near", "fx_candidates", "fx_stored_titles", extra=NEAR))
def near_duplicate_titles(fx):
    titles = gate.recent_titles(fx.stored_titles(), fixtures.now())
    return gate.near_duplicate_titles(fx.candidates(), titles).select("id")


@query(
    "near_duplicate_in_batch",
    with_views(
        """SELECT id, in_batch FROM walk""",
        "fx_candidates", "fx_sources",
        recursive=True,
        extra={
            "fresh": FRESH,
            "fresh_sets": f"SELECT id, source_id, place, NOT paywalled AS eligible, {shingles('title')} AS s FROM fresh",
            "walk": """
                SELECT source_id, place, id, FALSE AS in_batch, CASE WHEN eligible THEN [s] ELSE [] END AS held FROM fresh_sets WHERE place = 1
                UNION ALL
                SELECT f.source_id, f.place, f.id, hit, CASE WHEN f.eligible AND NOT hit THEN list_append(w.held, f.s) ELSE w.held END
                FROM walk w JOIN fresh_sets f ON f.source_id = w.source_id AND f.place = w.place + 1,
                LATERAL (SELECT len(list_filter(w.held, lambda h: len(list_intersect(h, f.s)) > 0 AND
                    len(list_intersect(h, f.s)) / (len(h) + len(f.s) - len(list_intersect(h, f.s))) > 0.8e0)) > 0 AS hit)""",
        },
    ),
)
def near_duplicate_in_batch(fx):
    fresh = gate.fresh_candidates(fx.candidates(), fx.sources(), fixtures.now())
    marked = gate.near_duplicate_in_batch(fresh.withColumn("eligible", ~F.col("paywalled")))
    return marked.select("id", "in_batch")


@query(
    "drop_arrived_since",
    with_views(
        "SELECT id FROM fx_candidates WHERE id NOT IN (SELECT id FROM near)",
        "fx_candidates", "fx_stored_titles",
        extra={
            "before": f"SELECT id, title FROM fx_stored_titles WHERE fetched_at >= {NOW} - INTERVAL 30 DAY AND fetched_at < {NOW} - INTERVAL 3 DAY",
            "recent": RECENT.format("fx_stored_titles"),
            "arrived": "SELECT DISTINCT title FROM recent WHERE title NOT IN (SELECT title FROM before)",
            "near": near_sql("fx_candidates", "arrived"),
        },
    ),
)
def drop_arrived_since(fx):
    stored = fx.stored_titles()
    before = gate.recent_titles(stored.filter(F.col("fetched_at") < fixtures.minus_hours(F.lit(72))), fixtures.now())
    return gate.drop_arrived_since(fx.candidates(), before, gate.recent_titles(stored, fixtures.now())).select("id")


def ratio(text_sql: str, pattern: str, least: int = 1) -> str:
    hits = f"len(regexp_extract_all({text_sql}, '{pattern}'))"
    plain = f"len(regexp_extract_all({text_sql}, '{LATIN}'))"
    return f"CASE WHEN {hits} >= {least} THEN {hits} / ({hits} + {plain}) ELSE 0e0 END"


FOREIGN_LIST = f"[{quoted(fixtures.FOREIGN_WORDS)}]"
ENGLISH_LIST = f"[{quoted(ENGLISH_FUNCTION_WORDS)}]"
STOPWORD_LIST = f"[{quoted(ENGLISH_STOPWORDS)}]"


def among(tokens: str, listed: str) -> str:
    return f"list_filter({tokens}, lambda t: list_contains({listed}, t))"


def language_view(source: str, body: str) -> str:
    """Measures of title and whole text, and the verdict, one row per id of a view."""
    tokens = "regexp_extract_all(lower({0}), '[\\p{{L}}'']+')"
    title_tokens, text_tokens = tokens.format("title"), tokens.format("txt")
    return f"""
        SELECT *, txt <> '' AND (title_other > 0.2e0 OR non_latin_ratio > 0.2e0
            OR (title_distinct >= 2 AND title_foreign > title_english) OR (foreign_distinct >= 3 AND foreign_words > english_words)
            OR title_accented > 0.12e0 OR accented_ratio > 0.12e0 OR coalesce(stopword_ratio < 0.08e0, FALSE)) AS is_non_english
        FROM (SELECT id, txt, {ratio('title', NON_LATIN)} AS title_other, {ratio('txt', NON_LATIN)} AS non_latin_ratio,
            {ratio('title', ACCENTED, 3)} AS title_accented, {ratio('txt', ACCENTED, 3)} AS accented_ratio,
            len({among('title_tokens', FOREIGN_LIST)}) AS title_foreign,
            len(list_distinct({among('title_tokens', FOREIGN_LIST)})) AS title_distinct,
            len({among('title_tokens', ENGLISH_LIST)}) AS title_english,
            len({among('text_tokens', FOREIGN_LIST)}) AS foreign_words,
            len(list_distinct({among('text_tokens', FOREIGN_LIST)})) AS foreign_distinct,
            len({among('text_tokens', ENGLISH_LIST)}) AS english_words,
            CASE WHEN len(ascii_tokens) >= 40 AND len(list_distinct(ascii_tokens)) >= 20
                THEN len({among('ascii_tokens', STOPWORD_LIST)}) / len(ascii_tokens) END AS stopword_ratio
        FROM (SELECT id, title, txt, {title_tokens} AS title_tokens, {text_tokens} AS text_tokens,
                regexp_extract_all(lower(txt), '[a-z'']+') AS ascii_tokens
            FROM (SELECT id, title, trim(title || ' ' || coalesce(summary, '') || ' ' || coalesce({body}, '')) AS txt FROM {source})))"""


@query(
    "language_gate",
    with_views(
        """SELECT id, is_non_english, round(non_latin_ratio, 6) AS non_latin_ratio, round(accented_ratio, 6) AS accented_ratio,
            foreign_words, english_words, round(coalesce(stopword_ratio, -1), 6) AS stopword_ratio FROM language""",
        "fx_candidates", extra={"language": language_view("fx_candidates", "body_text")},
    ),
)
def language_gate(fx):
    judged = gate.language_gate(fx.candidates(), fixtures.LEXICON)
    return judged.select(
        "id", "is_non_english", rounded("non_latin_ratio").alias("non_latin_ratio"), rounded("accented_ratio").alias("accented_ratio"),
        F.col("foreign_words").cast("bigint").alias("foreign_words"), F.col("english_words").cast("bigint").alias("english_words"),
        rounded(F.coalesce("stopword_ratio", F.lit(-1.0))).alias("stopword_ratio"),
    )


def names_alias(text_sql: str) -> str:
    return f"len(list_filter(aliases, lambda a: contains({text_sql}, a))) > 0"


def scored_view(source: str = "fx_candidates") -> str:
    body = "trim(lower(coalesce(c.summary, '') || ' ' || coalesce(c.body_text, '')))"
    lead = f"array_to_string(list_slice(regexp_split_to_array(txt, '{WS}+'), 1, 300), ' ')"
    weights = gate.WEIGHTS
    base = f"(((0e0 + relevance * {number(weights['relevance'])}) + trust_score * {number(weights['trust'])}) + substance * {number(weights['substance'])}) + freshness * {number(weights['freshness'])}"
    total = "(((0e0 + 0.35e0) + 0.2e0) + 0.2e0) + 0.1e0"
    return f"""
        SELECT *, least(1e0, greatest(0e0, CASE WHEN engagement IS NULL THEN ({base}) / ({total})
            ELSE (({base}) + engagement * 0.15e0) / (({total}) + 0.15e0) END)) AS score
        FROM (SELECT *,
            CASE WHEN {names_alias('lower(title)')} THEN 1e0 WHEN txt = '' THEN 0e0 WHEN {names_alias(lead)} THEN 0.7e0
                WHEN {names_alias('txt')} THEN 0.3e0 ELSE 0e0 END AS relevance,
            {table_case('trust', gate.TRUST_SCORES, 0.2)} AS trust_score,
            CASE WHEN kind IN ('release', 'video') THEN 1e0
                WHEN content_words >= 400 OR coalesce(regexp_matches(body_text, '{gate.CODE_PATTERN}'), FALSE) THEN 1e0
                WHEN content_words >= 150 THEN 0.5e0 ELSE 0e0 END AS substance,
            CASE WHEN platform IS NOT NULL AND engagement_count IS NOT NULL THEN least(1e0, greatest(0e0,
                log10(engagement_count + 1e0) / log10({table_case('platform', gate.ENGAGEMENT_REFERENCE, 50)} + 1e0))) END AS engagement,
            {recency('published_at')} AS freshness
        FROM (SELECT c.*, coalesce(x.aliases, []) AS aliases, coalesce(x.trust, 'unknown') AS trust, {body} AS txt,
                coalesce(len({words('coalesce(c.body_text, c.summary)')}), 0) AS content_words
            FROM {source} c LEFT JOIN context x USING (source_id)))"""


SCORE_VIEWS = ("fx_candidates", *CONTEXT_VIEWS)
SCORED = {"context": CONTEXT, "scored": scored_view()}


def _scored(fx):
    context = gate.source_context(fx.sources(), fx.source_topics(), fx.topic_aliases())
    known = checked_join(fx.candidates(), context.select("source_id", "aliases", "trust"), "source_id", spread_by="id")
    return gate.score_terms(known.filter(F.col("trust").isNotNull()), fixtures.now())


@query("relevance", with_views("SELECT id, relevance FROM scored", *SCORE_VIEWS, extra=SCORED))
def relevance(fx):
    return _scored(fx).select("id", "relevance")


@query("substance", with_views("SELECT id, content_words, substance FROM scored", *SCORE_VIEWS, extra=SCORED))
def substance(fx):
    return _scored(fx).select("id", F.col("content_words").cast("bigint").alias("content_words"), "substance")


@query(
    "score_candidates",
    with_views(
        """SELECT id, relevance, trust_score, substance, round(coalesce(engagement, -1), 6) AS engagement,
            round(freshness, 6) AS freshness, round(score, 6) AS score FROM scored""",
        *SCORE_VIEWS, extra=SCORED,
    ),
)
def score_candidates(fx):
    return _scored(fx).select(
        "id", "relevance", "trust_score", "substance", rounded(F.coalesce("engagement", F.lit(-1.0))).alias("engagement"),
        rounded("freshness").alias("freshness"), rounded("score").alias("score"),
    )


def verdict_view(scored: str = "scored", near: str = "near") -> str:
    return f"""
        SELECT id, reason, reason = 'qualified' AS accepted, CASE WHEN hard IS NULL THEN score ELSE 0e0 END AS score,
            CASE WHEN hard IS NULL THEN relevance ELSE 0e0 END AS relevance, CASE WHEN hard IS NULL THEN engagement END AS engagement
        FROM (SELECT *, coalesce(hard, CASE WHEN relevance = 0 THEN 'no_topic_relevance'
                WHEN substance = 0 AND content_words > 0 THEN 'thin_content' WHEN substance = 0 THEN 'no_extractable_content'
                WHEN coalesce(kind, '') <> 'release' AND coalesce({days_old('published_at')} > 60, FALSE) THEN 'stale'
                WHEN score >= 0.6e0 THEN 'qualified' ELSE 'below_threshold' END) AS reason
            FROM (SELECT s.*, CASE WHEN duplicate THEN 'duplicate_url_hash' WHEN {AGGREGATOR} THEN 'aggregator_domain'
                WHEN {SPAM} THEN 'spam_markers' WHEN {PAYWALLED} THEN 'paywalled_without_summary'
                WHEN s.id IN (SELECT id FROM {near}) THEN 'near_duplicate_title' WHEN l.is_non_english THEN 'non_english' END AS hard
            FROM {scored} s JOIN language l USING (id)))"""


QUALIFIED = {**NEAR, **SCORED, "language": language_view("fx_candidates", "body_text"), "verdict": verdict_view()}


def qualified(fx):
    context = gate.source_context(fx.sources(), fx.source_topics(), fx.topic_aliases())
    titles = gate.recent_titles(fx.stored_titles(), fixtures.now())
    return gate.qualify(fx.candidates(), context, fixtures.now(), titles, lexicon=fixtures.LEXICON)


@query(
    "qualify",
    with_views(
        """SELECT id, accepted, round(score, 6) AS score, reason, relevance, round(coalesce(engagement, -1), 6) AS engagement FROM verdict""",
        *SCORE_VIEWS, "fx_stored_titles", extra=QUALIFIED,
    ),
)
def qualify(fx):
    return qualified(fx).select(
        "id", "accepted", rounded("score").alias("score"), "reason", F.col("breakdown.relevance").alias("relevance"),
        rounded(F.coalesce("breakdown.engagement", F.lit(-1.0))).alias("engagement"),
    )

"""The qualification gate: cheap rejects first, then a transparent weighted score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.language import Lexicon, is_non_english, language_measures
from gleaner.functions.links import site_of
from gleaner.functions.scoring import age_days, clamp01, days_before, iff, recency
from gleaner.functions.text import SPACE, any_of, array_of_strings, let, trimmed, word_total
from gleaner.operators.precedence import blocked_nodes
from gleaner.operators.similarity import (
    NEAR_DUPLICATE_THRESHOLD,
    near_duplicate_titles,
    similar_sets,
    title_sets,
    with_title_key,
)
from gleaner.operators.skew import checked_join
from gleaner.session import settled

# The five weights, the bar, and the engagement redistributed when unreported.
WEIGHTS = {"relevance": 0.35, "trust": 0.2, "substance": 0.2, "engagement": 0.15, "freshness": 0.1}
QUALIFICATION_THRESHOLD = 0.6

# Trust of a source tier.
TRUST_SCORES = {"official": 1.0, "community": 0.7, "probationary": 0.4, "unknown": 0.2}

# Engagement that counts as full on each platform.
ENGAGEMENT_REFERENCE = {
    "hacker_news": 50,
    "reddit": 200,
    "dev_to": 30,
    "stack_exchange": 20,
    "github": 100,
    "youtube": 5000,
}
DEFAULT_ENGAGEMENT_REFERENCE = 50

# Sizes and ages the rules compare with.
LEAD_WORDS = 300
SUBSTANTIAL_WORDS = 400
THIN_WORDS = 150
STALE_DAYS = 60
DEFAULT_ARTICLE_AGE_DAYS = 30
CANDIDATES_PER_SOURCE = 20
ENRICHMENTS_PER_RUN = 12
RECENT_TITLE_DAYS = 30
RECENT_TITLE_LIMIT = 500
PAYWALL_CHARS = 400

# Sites that republish other people's writing.
AGGREGATOR_DOMAINS = [
    "news.ycombinator.com",
    "reddit.com",
    "lobste.rs",
    "techmeme.com",
    "flipboard.com",
    "getpocket.com",
    "news.google.com",
    "medium.datadriveninvestor.com",
    "hackernewsletter.com",
]

# Phrases of paid content and of paywalls.
SPAM_MARKERS = [
    "sponsored post",
    "paid partnership",
    "this post is sponsored",
    "affiliate link",
    "buy now",
    "coupon code",
]
PAYWALL_MARKERS = [
    "subscribe to continue",
    "subscribers only",
    "this article is for paid",
    "become a member to read",
    "create an account to keep reading",
]

# What code looks like in plain text.
CODE_PATTERN = (
    r"```|\b(?:npm|npx|pnpm|yarn|pip|cargo)\s+\w+"
    r"|\b(?:const|let|function|import|export|def|class)\s+[A-Za-z_$]"
)


def fresh_candidates(
    candidates: DataFrame, sources: DataFrame, now: Column, per_source: int | None = None
) -> DataFrame:
    """Dated inside the source's age limit; texts stay where they are.

    ``per_source`` keeps the first ones of each source only, in payload order; a request
    with a time budget passes CANDIDATES_PER_SOURCE. Only (source, position, id) are
    ranked for that, and each task passes on no more than a source may keep.
    """
    limits = sources.select(
        "source_id", F.coalesce("max_article_age_days", F.lit(DEFAULT_ARTICLE_AGE_DAYS)).alias("age_limit")
    )
    dated = candidates.filter(F.col("published_at").isNotNull()).join(limits, "source_id")
    fresh = dated.filter(F.col("published_at") >= days_before(now, F.col("age_limit"))).drop("age_limit")
    if per_source is None:
        return fresh
    order = Window.partitionBy("source_id").orderBy("position", "id")
    first = fresh.select("source_id", "position", "id").withColumn("place", F.row_number().over(order))
    return fresh.join(first.filter(F.col("place") <= per_source).select("id"), "id", "left_semi")


def source_context(
    sources: DataFrame, source_topics: DataFrame, topic_aliases: DataFrame, discovery: bool = False
) -> DataFrame:
    """source_id, aliases, trust, topic_ids and error for every source.

    A source that declares no topics is measured against the whole dictionary,
    which only an official feed may do.
    """
    every_alias = topic_aliases.agg(F.array_sort(F.collect_set(F.lower("alias"))).alias("aliases"))
    declared = (
        source_topics.join(topic_aliases, "topic_id", "left")
        .groupBy("source_id")
        .agg(
            F.array_sort(F.collect_set(F.lower("alias"))).alias("own_aliases"),
            F.array_sort(F.collect_set("topic_id")).alias("topic_ids"),
        )
    )
    undeclared = F.col("topic_ids").isNull()
    lenient = F.lit(not discovery) & (F.coalesce("trust_tier", F.lit("official")) == "official")
    return sources.join(declared, "source_id", "left").select(
        "source_id",
        F.when(undeclared, every_alias.scalar()).otherwise(F.col("own_aliases")).alias("aliases"),
        F.when(F.col("trust_tier").isin(list(TRUST_SCORES)), F.col("trust_tier")).otherwise("unknown").alias("trust"),
        F.coalesce("topic_ids", F.array().cast("array<bigint>")).alias("topic_ids"),
        F.when(undeclared & ~lenient, F.lit("SOURCE_TOPICS_MISSING")).alias("error"),
    )


def needs_enrichment() -> Column:
    return F.coalesce(F.col("image_url") == "", F.lit(True)) | (word_total(F.col("body_text")) < SUBSTANTIAL_WORDS)


def enrich_from_pages(
    candidates: DataFrame, pages: DataFrame, per_source: int | None = None
) -> DataFrame:
    """Fill gaps of under-described candidates from page metadata; the wordier body wins.

    ``pages`` is keyed by canonical_url. ``per_source`` keeps a request's budget of
    page look-ups (ENRICHMENTS_PER_RUN); by default every page is looked up.
    """
    asked = candidates.withColumn("wanted", needs_enrichment())
    if per_source is not None:
        turn = F.row_number().over(Window.partitionBy("source_id").orderBy("position", "id"))
        chosen = (
            asked.filter("wanted").select("id", "source_id", "position").withColumn("turn", turn)
            .filter(F.col("turn") <= per_source).select("id", F.lit(True).alias("chosen"))
        )
        asked = asked.join(chosen, "id", "left").withColumn("wanted", iff(F.col("chosen"))).drop("chosen")
    page = pages.select(
        F.col("canonical_url"),
        F.lit(True).alias("page_found"),
        *[F.col(name).alias(f"page_{name}") for name in ("author", "summary", "body_text", "image_url")],
    )
    joined = asked.join(page, "canonical_url", "left")
    used = F.col("wanted") & iff(F.col("page_found"))
    wordier = word_total(F.col("page_body_text")) > word_total(F.col("body_text"))
    result = joined.withColumn("enriched", used).withColumn(
        "body_text", F.when(used & wordier, F.col("page_body_text")).otherwise(F.col("body_text"))
    )
    for name in ("author", "summary", "image_url"):
        result = result.withColumn(name, F.when(used, F.coalesce(name, f"page_{name}")).otherwise(F.col(name)))
    return result.drop("wanted", "page_found", "page_author", "page_summary", "page_body_text", "page_image_url")


def page_attempts(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, source_id, url, error_code) of every page that a candidate asked for; the code is null if it was read.

    ``pages`` may have an error_code for pages that could not be read; a page that is
    missing was never fetched.
    """
    code = F.col("error_code") if "error_code" in pages.columns else F.lit(None).cast("string")
    known = pages.select("canonical_url", F.struct(code.alias("code")).alias("page"))
    wanted = candidates.filter(needs_enrichment()).select("id", "source_id", "canonical_url")
    missing = F.when(F.col("page").isNull(), "NOT_FETCHED").otherwise(F.col("page.code"))
    return wanted.join(known, "canonical_url", "left").select(
        "id", "source_id", F.col("canonical_url").alias("url"), missing.alias("error_code")
    )


def is_aggregator(url: Column, domains: Sequence[str] = tuple(AGGREGATOR_DOMAINS)) -> Column:
    listed = "|".join(domain.replace(".", "[.]") for domain in domains)
    return F.coalesce(site_of(url).rlike(rf"(^|[.])({listed})$"), F.lit(True))


def reject_aggregators(candidates: DataFrame) -> DataFrame:
    """Candidates whose link belongs to a republisher, or to no host at all."""
    return candidates.filter(is_aggregator(F.col("canonical_url")))


def has_spam() -> Column:
    return any_of(F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))), SPAM_MARKERS)


def is_paywalled() -> Column:
    empty = (F.coalesce("summary", F.lit("")) == "") & (F.coalesce("body_text", F.lit("")) == "")
    text = F.lower(F.coalesce("body_text", "summary", F.lit("")))
    return (iff(F.col("paywalled")) & empty) | ((F.length(text) < PAYWALL_CHARS) & any_of(text, PAYWALL_MARKERS))


def reject_markers(candidates: DataFrame) -> DataFrame:
    """Candidates that are paid content or an empty paywall, with the reason."""
    reason = F.when(has_spam(), "spam_markers").when(is_paywalled(), "paywalled_without_summary")
    return candidates.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def recent_titles(
    items: DataFrame, now: Column, days: int = RECENT_TITLE_DAYS, limit: int | None = None
) -> DataFrame:
    """Stored titles inside the window; the newest ``limit`` only, if asked (a request loads RECENT_TITLE_LIMIT)."""
    recent = items.filter(F.col("fetched_at") >= days_before(now, F.lit(days))).select("id", "title", "fetched_at")
    return recent if limit is None else recent.orderBy(F.col("fetched_at").desc(), "id").limit(limit)


def near_duplicate_in_batch(
    candidates: DataFrame, threshold: float = NEAR_DUPLICATE_THRESHOLD, within: str | None = "source_id"
) -> DataFrame:
    """Adds in_batch: near-duplicate of an earlier accepted candidate of the same run.

    A run is the candidates of one ``within`` value, or all of them for ``None``; its
    order is (position, id), or (place, id) where candidates have a place, after
    ``within`` if the run spans all. Only an eligible
    candidate that is no near-duplicate itself blocks others.

    Candidates of one run with equal titles collapse to the first eligible one, which
    blocks the later ones whatever becomes of it: what blocks it blocks them too. The
    others meet through the similarity join and are decided first come, first served
    (``precedence.blocked_nodes``).
    """
    whole = F.lit("") if within is None else F.col(within)
    turn = "place" if "place" in candidates.columns else "position"
    order = F.struct(*([] if within else ["source_id"]), turn, "id")
    keyed = with_title_key(candidates.select("id", "title", "eligible", whole.alias("run"), order.alias("turn")))
    keyed = settled(keyed.filter(F.col("set_id").isNotNull()).select("id", "run", "turn", "eligible", "set_id", "shingles"))
    pairs = settled(similar_sets(title_sets(keyed), threshold).select("set_a", "set_b"))
    both = pairs.select(F.col("set_a").alias("set_id"), F.col("set_b").alias("other")).unionByName(
        pairs.select(F.col("set_b").alias("set_id"), F.col("set_a").alias("other"))
    )
    firsts = settled(keyed.filter("eligible").groupBy("run", "set_id").agg(F.min("turn").alias("first")))
    earlier = firsts.select("run", F.col("set_id").alias("other"), F.col("first").alias("other_first"))
    # later set <- earlier set, of one run
    edges = firsts.join(both, "set_id").join(earlier, ["run", "other"]).filter("other_first < first")
    edges = settled(
        edges.select("run", F.col("set_id").alias("later"), F.col("other").alias("earlier"), F.col("first").alias("turn"))
    )
    blocked = blocked_nodes(edges).withColumnRenamed("node", "set_id")
    accepted = firsts.select("run", "set_id").join(blocked, ["run", "set_id"], "left_anti")
    blockers = firsts.join(settled(accepted), ["run", "set_id"]).withColumnRenamed("set_id", "other")
    similar = blockers.join(both, "other").groupBy("run", "set_id").agg(F.min("first").alias("similar_first"))
    judged = (
        keyed.select("id", "run", "turn", "set_id")
        .join(firsts, ["run", "set_id"], "left")
        .join(similar, ["run", "set_id"], "left")
        .filter(iff(F.col("first") < F.col("turn")) | iff(F.col("similar_first") < F.col("turn")))
    )
    blocked = settled(judged.select("id", F.lit(True).alias("in_batch")).distinct())
    return candidates.join(blocked, "id", "left").withColumn("in_batch", iff(F.col("in_batch")))


def drop_arrived_since(accepted: DataFrame, snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Accepted candidates left after dropping doubles of titles stored since the snapshot."""
    arrived = current.select("title").join(snapshot.select("title"), "title", "left_anti").distinct()
    doubles = near_duplicate_titles(accepted.select("id", "title"), arrived)
    return accepted.join(doubles.select("id"), "id", "left_anti")


def language_gate(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds is_non_english and its measures to rows with title, summary and body_text."""
    parts = (F.col("title"), F.col("summary"), F.col("body_text"))
    return (
        docs.withColumn("measures", language_measures(*parts, lexicon))
        .withColumn("non_latin_ratio", F.col("measures.non_latin_ratio"))
        .withColumn("accented_ratio", F.col("measures.accented_ratio"))
        .withColumn("foreign_words", F.col("measures.balance.foreign"))
        .withColumn("english_words", F.col("measures.balance.english"))
        .withColumn("stopword_ratio", F.col("measures.stopword_ratio"))
        .withColumn("is_non_english", is_non_english(*parts, lexicon))
        .drop("measures")
    )


def relevance(title: Column, summary: Column, body: Column, aliases: Column) -> Column:
    """1 in the title, 0.7 in the lead words, 0.3 further down, 0 nowhere."""
    both = F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(body, F.lit("")))

    def names(where: Column) -> Column:
        return let(where, lambda text: F.exists(aliases, lambda alias: F.contains(text, alias)))

    def lead(text: Column) -> Column:
        return F.array_join(F.slice(F.split(text, f"{SPACE}+", LEAD_WORDS + 1), 1, LEAD_WORDS), " ")

    def in_text(text: Column) -> Column:
        return let(
            names(lead(text)), lambda ahead: F.when(ahead, 0.7).when(~names(text) & ~ahead, 0.0).otherwise(0.3)
        )

    return F.when(names(F.lower(title)), 1.0).otherwise(let(trimmed(F.lower(both)), in_text))


def content_words() -> Column:
    return word_total(F.coalesce("body_text", "summary"))


def substance() -> Column:
    whole = F.col("kind").isin("release", "video")
    code = iff(F.col("body_text").rlike(CODE_PATTERN))
    return (
        F.when(iff(whole), 1.0)
        .when((F.col("content_words") >= SUBSTANTIAL_WORDS) | code, 1.0)
        .when(F.col("content_words") >= THIN_WORDS, 0.5)
        .otherwise(0.0)
    )


def _lookup(key: Column, table: dict, default: float) -> Column:
    result = F.lit(float(default))
    for name, value in table.items():
        result = F.when(key == name, float(value)).otherwise(result)
    return result


def score_terms(candidates: DataFrame, now: Column) -> DataFrame:
    """Adds the five terms and the score; needs aliases and trust on each row."""
    reference = _lookup(F.col("platform"), ENGAGEMENT_REFERENCE, DEFAULT_ENGAGEMENT_REFERENCE)
    reported = F.col("platform").isNotNull() & F.col("engagement_count").isNotNull()
    engagement = F.when(
        reported, clamp01(F.log10(F.col("engagement_count") + F.lit(1.0)) / F.log10(reference + F.lit(1.0)))
    )
    scored = candidates.withColumn("content_words", content_words()).withColumns(
        {
            "relevance": relevance(F.col("title"), F.col("summary"), F.col("body_text"), F.col("aliases")),
            "trust_score": _lookup(F.col("trust"), TRUST_SCORES, TRUST_SCORES["unknown"]),
            "substance": substance(),
            "engagement": engagement,
            "freshness": recency(F.col("published_at"), now),
        }
    )
    weighted = F.lit(0.0)
    total = 0.0
    for column, name in (("relevance", "relevance"), ("trust_score", "trust"), ("substance", "substance"), ("freshness", "freshness")):
        weighted = weighted + F.col(column) * F.lit(WEIGHTS[name])
        total += WEIGHTS[name]
    with_engagement = (weighted + F.col("engagement") * F.lit(WEIGHTS["engagement"])) / F.lit(total + WEIGHTS["engagement"])
    return scored.withColumn("score", clamp01(F.coalesce(with_engagement, weighted / F.lit(total))))


def is_stale(now: Column) -> Column:
    aged = iff(age_days(F.col("published_at"), now) > STALE_DAYS)
    return aged & ~iff(F.col("kind") == "release")


# Long texts and the dictionary stay behind once a candidate is judged.
JUDGED_TEXTS = ["summary", "body_text", "aliases"]


def qualify(
    candidates: DataFrame,
    context: DataFrame,
    now: Column,
    titles: DataFrame | None = None,
    *,
    lexicon: Lexicon,
) -> DataFrame:
    """Verdict per candidate: accepted, score, reason and the breakdown.

    Columns used: id, source_id, title, summary, body_text, canonical_url,
    published_at, kind, engagement_count, platform, paywalled, duplicate.
    Everything that reads texts happens where they are scanned; what is joined
    with the near-duplicates and returned is narrow.
    """
    known = (
        checked_join(candidates, context.select("source_id", "aliases", "trust"), "source_id", spread_by="id")
        .withColumn("trust", F.coalesce("trust", F.lit("unknown")))
        .withColumn("aliases", F.coalesce("aliases", array_of_strings()))
    )
    hard = (
        F.when(iff(F.col("duplicate")), "duplicate_url_hash")
        .when(is_aggregator(F.col("canonical_url")), "aggregator_domain")
        .when(has_spam(), "spam_markers")
        .when(is_paywalled(), "paywalled_without_summary")
    )
    foreign = F.col("hard").isNull() & is_non_english(F.col("title"), F.col("summary"), F.col("body_text"), lexicon)
    judged = score_terms(known.withColumn("hard", hard).withColumn("foreign", foreign), now).drop(*JUDGED_TEXTS)
    near = F.lit(False)
    if titles is not None:
        # Titles are read once from where the texts are, and are narrow from then on.
        doubles = near_duplicate_titles(settled(candidates.select("id", "title")), titles.select("title"))
        judged = judged.join(doubles.select("id", F.lit(True).alias("near_stored")), "id", "left")
        near = iff(F.col("near_stored"))
    rejection = F.coalesce(
        "hard", F.when(near, "near_duplicate_title"), F.when(F.col("foreign"), "non_english")
    )
    soft = (
        F.when(F.col("relevance") == 0, "no_topic_relevance")
        .when((F.col("substance") == 0) & (F.col("content_words") > 0), "thin_content")
        .when(F.col("substance") == 0, "no_extractable_content")
        .when(is_stale(now), "stale")
        .when(F.col("score") >= QUALIFICATION_THRESHOLD, "qualified")
        .otherwise("below_threshold")
    )
    judged = judged.withColumn("rejection", rejection)
    rejected = F.col("rejection").isNotNull()

    def unless_rejected(name: str) -> Column:
        return F.when(rejected, 0.0).otherwise(F.col(name))

    breakdown = F.struct(
        unless_rejected("relevance").alias("relevance"),
        unless_rejected("trust_score").alias("trust"),
        unless_rejected("substance").alias("substance"),
        F.when(~rejected, F.col("engagement")).alias("engagement"),
        unless_rejected("freshness").alias("freshness"),
    )
    return (
        judged.withColumns(
            {
                "reason": F.coalesce("rejection", soft),
                "score": unless_rejected("score"),
                "breakdown": breakdown,
            }
        )
        .withColumn("accepted", F.col("reason") == "qualified")
        .drop("hard", "foreign", "rejection", "near_stored", "relevance", "trust_score", "substance", "engagement", "freshness")
    )

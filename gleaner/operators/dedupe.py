"""Near-duplicate groups across the stored corpus, and what merging them moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.language import Lexicon, is_non_english
from gleaner.functions.scoring import MICROS_PER_DAY, days_before
from gleaner.functions.text import is_real_author
from gleaner.operators.components import connected_components
from gleaner.operators.similarity import NEAR_DUPLICATE_THRESHOLD, similar_sets, title_sets, with_title_key
from gleaner.session import settled

# Dates further apart than this are separate editions.
MAX_DAY_SPREAD = 7
# Body words that count as a full text, and the worth of each part of a card.
SUBSTANTIAL_BODY_WORDS = 150
FULL_BODY, SOME_BODY, IMAGE, BYLINE = 4, 2, 2, 1


def richness() -> Column:
    body_words = F.coalesce(F.regexp_count("body_content", F.lit(r"\S+")), F.lit(0))
    body = F.when(body_words >= SUBSTANTIAL_BODY_WORDS, FULL_BODY).when(body_words > 0, SOME_BODY).otherwise(0)
    image = F.when(F.col("image_url") != "", IMAGE).otherwise(0)
    return body + image + F.when(is_real_author(F.col("author")), BYLINE).otherwise(0)


def _slot() -> Column:
    """Seven-day slot of an item; two items of one slot are always close enough."""
    return F.floor(F.unix_micros("published_at") / (MAX_DAY_SPREAD * MICROS_PER_DAY))


def _slots(keyed: DataFrame) -> DataFrame:
    """Copies of one title summed up per seven-day slot, with map-side combining."""
    return (
        keyed.filter(F.col("set_id").isNotNull())
        .groupBy("set_id", _slot().alias("slot"))
        .agg(
            F.min("published_at").alias("first_at"),
            F.max("published_at").alias("last_at"),
            F.count(F.lit(1)).alias("items"),
        )
    )


def _editions(slots: DataFrame) -> DataFrame:
    """Number the runs of slots of one title that no seven-day gap interrupts.

    Equal titles form one edition while consecutive dates stay within the
    spread; a copy without a date ties all of them together. The window runs
    over slots, of which a title has at most one per week, never over items.
    """
    by_title = Window.partitionBy("set_id")
    in_order = by_title.orderBy(F.col("slot").asc_nulls_last())
    gap = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(in_order))
    starts = F.coalesce(gap > MAX_DAY_SPREAD * MICROS_PER_DAY, F.lit(False)).cast("int")
    undated = F.max(F.col("slot").isNull()).over(by_title)
    return (
        slots.withColumn("undated", undated)
        .withColumn("starts", starts)
        .withColumn("edition", F.when(F.col("undated"), 0).otherwise(F.sum("starts").over(in_order)))
        .withColumn("node", F.concat_ws(":", "set_id", "edition"))
    )


def _nodes(editions: DataFrame) -> DataFrame:
    return editions.groupBy("node", "set_id").agg(
        F.max("undated").alias("undated"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.sum("items").alias("items"),
    )


def _close(a: str, b: str) -> Column:
    """Some item of one edition lies within the spread of some item of the other."""
    spread = MAX_DAY_SPREAD * MICROS_PER_DAY
    start = F.greatest(F.unix_micros(f"{a}.first_at"), F.unix_micros(f"{b}.first_at"))
    end = F.least(F.unix_micros(f"{a}.last_at"), F.unix_micros(f"{b}.last_at"))
    return F.col(f"{a}.undated") | F.col(f"{b}.undated") | (start - end <= spread)


def _edition_links(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    a, b = nodes.alias("a"), nodes.alias("b")
    return (
        pairs.join(a, F.col("set_a") == F.col("a.set_id"))
        .join(b, F.col("set_b") == F.col("b.set_id"))
        .filter(_close("a", "b"))
        .select(
            F.col("a.node").alias("src"),
            F.col("b.node").alias("dst"),
            "similarity",
            F.col("a.items").alias("items_a"),
            F.col("b.items").alias("items_b"),
        )
    )


def duplicate_pairs(items: DataFrame, threshold: float = NEAR_DUPLICATE_THRESHOLD) -> DataFrame:
    """Linked title editions: near-identical titles published close enough together.

    Copies of one title in one run of dates are a single edition carrying its
    item count, so the output does not grow with the square of the copies.
    """
    keyed = settled(with_title_key(items.select("title", "published_at")).drop("title"))
    nodes = _nodes(_editions(_slots(keyed)))
    return _edition_links(nodes, similar_sets(title_sets(keyed), threshold))


def _placed(keyed: DataFrame, editions: DataFrame, *carried: str) -> DataFrame:
    """Items with the node of their edition and its carried columns."""
    slots = editions.select("set_id", F.col("slot").alias("edition_slot"), "node", *carried)
    same_slot = keyed["slot"].eqNullSafe(F.col("edition_slot"))
    return keyed.join(slots, (keyed["set_id"] == slots["set_id"]) & same_slot).drop("set_id", "edition_slot")


def edition_members(items: DataFrame) -> DataFrame:
    """(node, id, items) for every item with a title: its edition, and how many items that has.

    The membership beside ``duplicate_pairs``, whose src and dst are these nodes;
    copies of one title are an edition of several items, one row for each.
    """
    keyed = settled(with_title_key(items.select("id", "title", "published_at", _slot().alias("slot"))).drop("title"))
    editions = _editions(_slots(keyed)).withColumn("items", F.sum("items").over(Window.partitionBy("node")))
    return _placed(keyed, settled(editions), "items").select("node", "id", "items")


def duplicate_groups(items: DataFrame, threshold: float = NEAR_DUPLICATE_THRESHOLD) -> DataFrame:
    """(id, group_id, keep_id) for every item that has a near-duplicate.

    Members of one edition share a node; editions are linked by similar titles
    and closed transitively. The keeper is the richest, then earliest item.
    """
    card = items.select(
        "id", "title", "published_at", "fetched_at", richness().alias("richness"), _slot().alias("slot")
    )
    # Bodies are read once; every later step works on these narrow rows.
    keyed = settled(with_title_key(card).drop("title"))
    editions = settled(_editions(_slots(keyed)))
    links = _edition_links(_nodes(editions), similar_sets(title_sets(keyed), threshold))
    components = connected_components(links.select("src", "dst"))
    placed = (
        _placed(keyed, editions)
        .select("id", "richness", "published_at", "fetched_at", "node")
        .join(components, "node", "left")
        .withColumn("group_id", F.coalesce("component", "node"))
    )
    far = F.lit("9999-01-01").cast("timestamp")
    order = F.struct(
        (-F.col("richness")).alias("richness"),
        F.coalesce("published_at", far).alias("published_at"),
        F.coalesce("fetched_at", far).alias("fetched_at"),
        F.col("id").alias("id"),
    )
    keepers = (
        placed.groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("members"), F.min(order)["id"].alias("keep_id"))
        .filter("members > 1")
    )
    return placed.select("id", "group_id").join(keepers, "group_id").select("id", "keep_id", "members")


def _moved(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach keep_id to a table that refers to items; untouched rows keep their item."""
    mapping = groups.select(F.col("id").alias("item_id"), "keep_id")
    return (
        table.join(mapping, "item_id", "left")
        .withColumn("from_loser", F.coalesce(F.col("keep_id") != F.col("item_id"), F.lit(False)))
        .withColumn("item_id", F.coalesce("keep_id", "item_id"))
        .drop("keep_id")
    )


def surviving_items(items: DataFrame, groups: DataFrame) -> DataFrame:
    return items.join(groups.filter("id <> keep_id").select("id"), "id", "left_anti")


def merge_topics(item_topics: DataFrame, groups: DataFrame) -> DataFrame:
    return _moved(item_topics, groups).select("item_id", "topic_id").distinct()


def merge_saves(saved: DataFrame, groups: DataFrame) -> DataFrame:
    """One save per reader and keeper: read if any copy was, dated from the first."""
    return _moved(saved, groups).groupBy("user_id", "item_id").agg(
        F.bool_or(F.coalesce("is_read", F.lit(False))).alias("is_read"), F.min("saved_at").alias("saved_at")
    )


def merge_submissions(submissions: DataFrame, groups: DataFrame) -> DataFrame:
    return _moved(submissions, groups).drop("from_loser")


def merge_signals(signals: DataFrame, groups: DataFrame) -> DataFrame:
    """Highest counts of any copy; platform and time of the copy with most engagement."""
    top = F.struct(F.coalesce("engagement_count", F.lit(0)).alias("count"), (~F.col("from_loser")).alias("own"), "origin")
    return (
        _moved(signals.withColumn("origin", F.col("item_id")), groups)
        .groupBy("item_id")
        .agg(
            F.max(F.coalesce("engagement_count", F.lit(0))).alias("engagement_count"),
            F.greatest(F.lit(1), F.max(F.coalesce("source_count", F.lit(1)))).alias("source_count"),
            F.max_by("platform", top).alias("platform"),
            F.max_by("collected_at", top).alias("collected_at"),
        )
    )


def merge_references(
    groups: DataFrame, item_topics: DataFrame, saved: DataFrame, submissions: DataFrame, signals: DataFrame
) -> dict[str, DataFrame]:
    """Every table that refers to items, re-pointed at the keepers."""
    return {
        "item_topics": merge_topics(item_topics, groups),
        "saved": merge_saves(saved, groups),
        "submissions": merge_submissions(submissions, groups),
        "signals": merge_signals(signals, groups),
    }


def dedupe_report(
    items: DataFrame, groups: DataFrame, item_topics: DataFrame, saved: DataFrame, submissions: DataFrame
) -> DataFrame:
    """One row of counts: scanned, groups, removed, saves and submissions moved, links merged."""
    losers = groups.filter("id <> keep_id").select(F.col("id").alias("item_id"), "keep_id")
    scanned = items.agg(F.count(F.lit(1)).alias("n"))
    removed = losers.agg(F.count_distinct("keep_id").alias("groups"), F.count(F.lit(1)).alias("removed"))
    saves = saved.join(losers, "item_id").agg(F.count_distinct("user_id", "keep_id").alias("n"))
    moved = submissions.join(losers, "item_id").agg(F.count(F.lit(1)).alias("n"))
    linked = item_topics.join(losers, "item_id").agg(F.count_distinct("keep_id", "topic_id").alias("n"))
    return removed.select(
        scanned.scalar().alias("scanned"),
        F.col("groups").alias("duplicate_groups"),
        F.col("removed").alias("items_removed"),
        saves.scalar().alias("saves_moved"),
        moved.scalar().alias("submissions_moved"),
        linked.scalar().alias("topic_links_merged"),
    )


def merge_submission(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Submitted pages folded into stored rows: the page fills gaps, the longer body wins."""
    s, p = stored.alias("s"), pages.alias("p")
    length_of = lambda side: F.length(F.coalesce(F.col(f"{side}.body_content"), F.lit("")))
    filled = ["title", "author", "summary", "image_url", "published_at"]
    return s.join(p, F.col("s.url_hash") == F.col("p.url_hash"), "full_outer").select(
        F.coalesce("s.url_hash", "p.url_hash").alias("url_hash"),
        F.col("s.id").alias("id"),
        *[F.coalesce(f"s.{name}", f"p.{name}").alias(name) for name in filled],
        F.when(length_of("p") > length_of("s"), F.col("p.body_content")).otherwise(F.col("s.body_content")).alias("body_content"),
        F.col("p.user_id").alias("saved_for"),
    )


def language_purge_plan(
    items: DataFrame,
    saved: DataFrame,
    submissions: DataFrame,
    now: Column,
    window_days: int = 90,
    limit: int | None = None,
    *,
    lexicon: Lexicon,
) -> DataFrame:
    """(id, action) of unreadable rows: reader_submission, saved_by_reader or remove."""
    recent = items.filter(F.col("fetched_at") >= days_before(now, F.lit(window_days)))
    if limit is not None:
        recent = recent.orderBy(F.col("fetched_at").desc(), "id").limit(limit)
    flagged = recent.filter(is_non_english(F.col("title"), F.col("summary"), F.col("body_content"), lexicon)).select("id")
    owners = lambda table, name: table.select(F.col("item_id").alias("id")).distinct().withColumn(name, F.lit(True))
    return (
        flagged.join(owners(submissions.filter(F.col("item_id").isNotNull()), "submitted"), "id", "left")
        .join(owners(saved, "saved"), "id", "left")
        .select(
            "id",
            F.when(F.col("submitted"), "reader_submission").when(F.col("saved"), "saved_by_reader").otherwise("remove").alias("action"),
        )
    )

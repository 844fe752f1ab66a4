"""RSS, Atom and video feeds: XML payload tables to candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.links import canonical_url, safe_image_url
from gleaner.functions.text import (
    NO_LIMITS,
    TextLimits,
    any_date,
    blank_to_null,
    cut,
    plain_text,
    strip_markup,
)

# Fixed value: the engagement a video needs.
MIN_VIDEO_ENGAGEMENT = 2_000

_IMAGE_NODES = "array<struct<_url:string,_href:string,_type:string,_VALUE:string>>"
_RSS_ITEM = (
    "title:string,link:string,guid:string,creator:string,author:string,description:string,content:string,"
    "encoded:string,pubDate:string,published:string,updated:string,"
    f"thumbnail:{_IMAGE_NODES},media:{_IMAGE_NODES},enclosure:{_IMAGE_NODES}"
)
_ATOM_ENTRY = (
    "id:string,title:string,link:array<struct<_rel:string,_href:string,_type:string,_VALUE:string>>,"
    "author:struct<name:string,_VALUE:string>,summary:string,content:string,published:string,updated:string,"
    f"thumbnail:{_IMAGE_NODES},media:{_IMAGE_NODES}"
)
FEED_SCHEMA = f"struct<channel:struct<item:array<struct<{_RSS_ITEM}>>>,entry:array<struct<{_ATOM_ENTRY}>>>"
VIDEO_SCHEMA = (
    "struct<entry:array<struct<videoId:string,title:string,link:array<struct<_href:string>>,"
    "author:struct<name:string>,published:string,group:struct<description:string,"
    "thumbnail:array<struct<_url:string>>,community:struct<starRating:struct<_count:string>,"
    "statistics:struct<_views:string>>>>>>"
)
# Prefixes such as dc: and media: are dropped, so one name reads every dialect.
XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "inferSchema": "false"}

CANDIDATE_COLUMNS = [
    "payload_id", "source_id", "position", "external_id", "canonical_url", "title", "author", "summary",
    "body_text", "published_at", "published_text", "image_url",
]


def _first_safe(nodes: Column, base: Column) -> Column:
    """First node that may be an image and has a safe address."""
    images = F.filter(
        nodes,
        lambda node: (F.coalesce(F.lower(F.trim(node["_type"])), F.lit("")) == "")
        | F.startswith(F.lower(F.trim(node["_type"])), F.lit("image/")),
    )
    urls = F.transform(images, lambda node: safe_image_url(F.coalesce(node["_url"], node["_href"]), base))
    return F.get(F.filter(urls, lambda url: url.isNotNull()), F.lit(0))


def _image_in_markup(markup: Column, base: Column) -> Column:
    source = F.regexp_extract(markup, r"(?i)<img\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.when(source != "", safe_image_url(source, base))


def pick_feed_image(thumbnail: Column, media: Column, enclosure: Column, markup: Column, base: Column) -> Column:
    """Thumbnail, media node, enclosure, then the first picture in the markup; safe ones only."""
    return F.coalesce(
        _first_safe(thumbnail, base), _first_safe(media, base), _first_safe(enclosure, base), _image_in_markup(markup, base)
    )


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select("payload_id", "source_id", F.from_xml("payload", schema, XML_OPTIONS).alias("feed"))


def _with_link(entries: DataFrame, link: Column, title: Column, limits: TextLimits) -> DataFrame:
    """Entries that have a readable title and a link that can be stored."""
    return (
        entries.withColumn("canonical_url", canonical_url(link))
        .withColumn("title", cut(plain_text(title), limits.title))
        .filter(F.col("canonical_url").isNotNull() & F.col("title").isNotNull())
    )


def _rss(feeds: DataFrame, limits: TextLimits) -> DataFrame:
    entries = feeds.select("payload_id", "source_id", F.posexplode("feed.channel.item").alias("position", "item"))
    markup = F.coalesce("item.description", "item.content", "item.encoded")
    written = F.coalesce("item.pubDate", "item.published", "item.updated")
    return _with_link(entries, F.col("item.link"), F.col("item.title"), limits).select(
        "payload_id",
        "source_id",
        "position",
        blank_to_null(F.col("item.guid")).alias("external_id"),
        "canonical_url",
        "title",
        cut(plain_text(F.coalesce("item.creator", "item.author")), limits.author).alias("author"),
        plain_text(markup, limits.summary).alias("summary"),
        plain_text(F.coalesce("item.encoded", "item.content"), limits.body).alias("body_text"),
        any_date(written).alias("published_at"),
        written.alias("published_text"),
        pick_feed_image(
            F.col("item.thumbnail"), F.col("item.media"), F.col("item.enclosure"), markup, F.col("canonical_url")
        ).alias("image_url"),
    )


def _atom(feeds: DataFrame, limits: TextLimits) -> DataFrame:
    entries = feeds.select("payload_id", "source_id", F.posexplode("feed.entry").alias("position", "item"))
    alternates = F.filter(
        F.transform(
            "item.link",
            lambda node: F.coalesce(
                F.when(
                    F.coalesce(blank_to_null(node["_rel"]), F.lit("alternate")) == "alternate",
                    blank_to_null(node["_href"]),
                ),
                blank_to_null(node["_VALUE"]),
            ),
        ),
        lambda href: href.isNotNull(),
    )
    enclosures = F.transform(
        F.filter(
            "item.link",
            lambda node: F.coalesce((node["_rel"] == "enclosure"), F.lit(False))
            | F.coalesce(F.startswith(node["_type"], F.lit("image/")), F.lit(False)),
        ),
        lambda node: F.struct(
            F.lit(None).cast("string").alias("_url"),
            node["_href"].alias("_href"),
            F.lit(None).cast("string").alias("_type"),
            F.lit(None).cast("string").alias("_VALUE"),
        ),
    )
    markup = F.coalesce("item.summary", "item.content")
    written = F.coalesce("item.published", "item.updated")
    return _with_link(entries, F.get(alternates, F.lit(0)), F.col("item.title"), limits).select(
        "payload_id",
        "source_id",
        "position",
        blank_to_null(F.col("item.id")).alias("external_id"),
        "canonical_url",
        "title",
        cut(plain_text(F.coalesce("item.author.name", "item.author._VALUE")), limits.author).alias("author"),
        plain_text(markup, limits.summary).alias("summary"),
        plain_text(F.col("item.content"), limits.body).alias("body_text"),
        any_date(written).alias("published_at"),
        written.alias("published_text"),
        pick_feed_image(
            F.col("item.thumbnail"), F.col("item.media"), enclosures, markup, F.col("canonical_url")
        ).alias("image_url"),
    )


def _first_entries(candidates: DataFrame, entries: int | None) -> DataFrame:
    if entries is None:
        return candidates
    place = F.row_number().over(Window.partitionBy("payload_id").orderBy("position"))
    return candidates.withColumn("_place", place).filter(F.col("_place") <= entries).drop("_place")


def normalize_rss(raw: DataFrame, limits: TextLimits = NO_LIMITS) -> DataFrame:
    """RSS payloads (payload_id, source_id, payload) to candidates; whole texts and all entries unless limited."""
    return _first_entries(_rss(_parsed(raw, FEED_SCHEMA), limits), limits.entries)


def normalize_atom(raw: DataFrame, limits: TextLimits = NO_LIMITS) -> DataFrame:
    """Atom payloads to candidates; whole texts and all entries unless limited."""
    return _first_entries(_atom(_parsed(raw, FEED_SCHEMA), limits), limits.entries)


def normalize_feeds(raw: DataFrame, limits: TextLimits = NO_LIMITS) -> DataFrame:
    """Payloads of either dialect; a payload is one or the other."""
    feeds = _parsed(raw, FEED_SCHEMA)
    return _first_entries(_rss(feeds, limits).unionByName(_atom(feeds, limits)), limits.entries)


def _count(text: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0)))


def normalize_youtube(raw: DataFrame, floor: int = MIN_VIDEO_ENGAGEMENT, limits: TextLimits = NO_LIMITS) -> DataFrame:
    """Channel feeds to videos that drew at least ``floor`` views and likes."""
    entries = _parsed(raw, VIDEO_SCHEMA).select(
        "payload_id", "source_id", F.posexplode("feed.entry").alias("position", "item")
    )
    video = blank_to_null(F.col("item.videoId"))
    target = F.coalesce(
        F.concat(F.lit("https://www.youtube.com/watch?v="), video), F.get("item.link", F.lit(0))["_href"]
    )
    thumbnail = F.get("item.group.thumbnail", F.lit(0))["_url"]
    engagement = _count(F.col("item.group.community.statistics._views")) + _count(F.col("item.group.community.starRating._count"))
    rows = entries.select(
        "payload_id",
        "source_id",
        "position",
        F.concat(F.lit("yt:"), video).alias("external_id"),
        canonical_url(target).alias("canonical_url"),
        cut(blank_to_null(F.col("item.title")), limits.title).alias("title"),
        blank_to_null(F.col("item.author.name")).alias("author"),
        strip_markup(F.col("item.group.description"), limits.short_summary).alias("summary"),
        strip_markup(F.col("item.group.description"), limits.body).alias("body_text"),
        any_date(F.col("item.published")).alias("published_at"),
        F.col("item.published").alias("published_text"),
        safe_image_url(thumbnail).alias("image_url"),
        engagement.alias("engagement_count"),
    )
    return rows.filter(F.col("canonical_url").isNotNull() & F.col("title").isNotNull() & (F.col("engagement_count") >= floor))

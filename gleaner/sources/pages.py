"""HTML page tables: metadata, body text and engagement.

The body is the ``<article>`` (else ``<main>``, else ``<body>``) block without
scripts, styles, navigation and footers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.links import canonical_url, resolve_link, safe_image_url, site_of, trusted_image_url
from gleaner.functions.text import (
    NO_LIMITS,
    TextLimits,
    any_date,
    clean_text,
    decode_entities,
    find_all,
    let,
    plain_text,
)

# JSON-LD types that are articles, and blocks that are never prose.
ARTICLE_TYPES = ["Article", "NewsArticle", "BlogPosting", "TechArticle", "Report"]
NOT_PROSE = ["script", "style", "noscript", "nav", "footer", "aside", "form", "header"]

_LD_FIELDS = (
    "`@type`:string,image:string,author:string,datePublished:string,dateCreated:string"
)
_LD_SCHEMA = f"struct<{_LD_FIELDS},`@graph`:array<struct<{_LD_FIELDS}>>>"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, quoted or not; null when absent."""
    pattern = rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    parts = [F.nullif(F.regexp_extract(tag, pattern, group), F.lit("")) for group in (1, 2, 3)]
    return F.coalesce(*parts)


def _metas(html: Column, limits: TextLimits = NO_LIMITS) -> Column:
    """array<struct<key, content>> of the page's meta tags."""
    return F.transform(
        find_all(html, r"(?i)(<meta\b[^>]*>)"),
        lambda tag: F.struct(
            F.coalesce(attribute(tag, "property"), attribute(tag, "name")).alias("key"),
            clean_text(decode_entities(attribute(tag, "content")), limits.meta).alias("content"),
        ),
    )


def _meta(*keys: str) -> Column:
    def first(key: str) -> Column:
        named = F.filter("metas", lambda meta: (meta["key"] == key) & meta["content"].isNotNull())
        return F.get(named, F.lit(0))["content"]

    return F.coalesce(*[first(key) for key in keys])


def _link(html: Column, relation: str) -> Column:
    tags = F.filter(find_all(html, r"(?i)(<link\b[^>]*>)"), lambda tag: F.lower(attribute(tag, "rel")) == relation)
    return let(F.get(tags, F.lit(0)), lambda tag: attribute(tag, "href"))


def _ld_article(html: Column) -> Column:
    """First JSON-LD node of an article type, top-level or inside @graph."""
    blocks = find_all(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>")
    one_schema, many_schema = _LD_SCHEMA, f"array<{_LD_SCHEMA}>"
    parsed = F.flatten(
        F.transform(
            blocks,
            lambda block: F.when(F.startswith(F.trim(block), F.lit("[")), F.from_json(block, many_schema)).otherwise(
                F.array(F.from_json(block, one_schema))
            ),
        )
    )

    def own(node: Column) -> Column:
        return F.struct(*[node[name].alias(name) for name in ("@type", "image", "author", "datePublished", "dateCreated")])

    nodes = F.flatten(
        F.transform(
            F.filter(parsed, lambda node: node.isNotNull()),
            lambda node: F.concat(F.array(own(node)), F.coalesce(node["@graph"], F.array().cast(f"array<struct<{_LD_FIELDS}>>"))),
        )
    )
    kinds = "|".join(ARTICLE_TYPES)
    return F.get(F.filter(nodes, lambda node: node["@type"].rlike(rf'(^|")({kinds})("|$)')), F.lit(0))


def _ld_value(value: Column, field: str) -> Column:
    """A JSON-LD value is text, an object with ``field``, or an array of either."""
    first = F.regexp_extract(value, rf'"{field}"\s*:\s*"([^"]*)"', 1)
    in_array = F.regexp_extract(value, r'^\[\s*"([^"]*)"', 1)
    plain = F.when(~F.trim(value).rlike(r"^[\[{]"), value)
    return F.coalesce(plain, F.nullif(in_array, F.lit("")), F.nullif(first, F.lit("")))


def _prose(html: Column) -> Column:
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for name in NOT_PROSE:
        bare = F.regexp_replace(bare, rf"(?is)<{name}\b.*?</{name}\s*>", " ")
    inside = [F.nullif(F.regexp_extract(bare, rf"(?is)<{name}\b[^>]*>(.*)</{name}\s*>", 1), F.lit("")) for name in ("article", "main", "body")]
    return F.coalesce(*inside, bare)


def extract_page_metadata(pages: DataFrame, limits: TextLimits = NO_LIMITS) -> DataFrame:
    """Metadata per page (page_id, url, html), one narrow pass over the markup."""
    html, url = F.col("html"), F.col("url")
    found = (
        pages.withColumn("metas", _metas(html, limits))
        .withColumn("article", _ld_article(html))
        .withColumn("body_text", plain_text(_prose(html), limits.body))
        .withColumn("canonical_link", _link(html, "canonical"))
        .withColumn("image_link", _link(html, "image_src"))
        .withColumn("document_title", plain_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), limits.title))
    )
    requested = F.coalesce(resolve_link(F.col("canonical_link"), url), url)
    title = F.coalesce(_meta("og:title", "twitter:title"), "document_title")
    author = F.coalesce(clean_text(_ld_value(F.col("article.author"), "name"), limits.author), _meta("author", "article:author", "byl"))
    summary = F.coalesce(_meta("description", "og:description", "twitter:description"), "body_text")
    image = F.coalesce(
        safe_image_url(_meta("og:image", "og:image:url"), url),
        safe_image_url(_ld_value(F.col("article.image"), "url"), url),
        safe_image_url(_meta("twitter:image", "twitter:image:src"), url),
        safe_image_url(F.col("image_link"), url),
    )
    published = F.coalesce(
        any_date(F.coalesce("article.datePublished", "article.dateCreated")),
        any_date(_meta("article:published_time", "datePublished", "date", "pubdate")),
    )
    return found.select(
        "page_id",
        "url",
        canonical_url(requested).alias("canonical_url"),
        F.coalesce(clean_text(title, limits.title), site_of(url)).alias("title"),
        clean_text(author, limits.author).alias("author"),
        clean_text(summary, limits.summary).alias("summary"),
        "body_text",
        image.alias("image_url"),
        published.alias("published_at"),
    )


def page_engagement(pages: DataFrame) -> DataFrame:
    """(page_id, engagement_count, image_url): most claps in the page's data, and a trusted image."""
    html = F.col("html")
    counts = F.transform(
        find_all(html, r"(?i)(?:clapCount|totalClapCount|totalClaps)\\?[\"']\s*:\s*(\d{1,9})"), lambda n: n.cast("bigint")
    )
    images = F.filter(
        _metas(html),
        lambda meta: F.lower(meta["key"]).isin("og:image", "og:image:url", "twitter:image", "twitter:image:src"),
    )
    trusted = F.filter(F.transform(images, lambda meta: trusted_image_url(meta["content"])), lambda url: url.isNotNull())
    return pages.select(
        "page_id",
        F.coalesce(F.array_max(counts), F.lit(0)).alias("engagement_count"),
        F.coalesce(F.get(trusted, F.lit(0)), let(_link(html, "image_src"), trusted_image_url)).alias("image_url"),
    )

"""URL canonicalisation as column expressions.

Dot segments, internationalised hosts and percent-normalisation of paths are
left as they are; everything below is about identity of ordinary article links.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import let, trimmed

# Query parameters that only say where a click came from.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["ref", "fbclid", "gclid"]
FEED_STAMP_KEY = "source"
FEED_STAMP_VALUE = "rss"

_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(trimmed(url), _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host_of(url: Column) -> Column:
    """Lower-case host without credentials and port; null when the URL has none."""
    return _host(_part(url, 2))


def site_of(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def link_error(url: Column) -> Column:
    """Why a link cannot be stored, null when it can."""
    return let(_parts(url), _error)


def _parts(url: Column) -> Column:
    return let(
        trimmed(url),
        lambda value: F.struct(
            F.lower(F.regexp_extract(value, _PARTS, 1)).alias("scheme"),
            F.regexp_extract(value, _PARTS, 2).alias("authority"),
            F.regexp_extract(value, _PARTS, 3).alias("path"),
            F.regexp_extract(value, _PARTS, 4).alias("query"),
        ),
    )


def _host(authority: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def _error(parts: Column) -> Column:
    unreadable = (F.coalesce(parts["scheme"], F.lit("")) == "") | _host(parts["authority"]).isNull()
    return (
        F.when(unreadable, F.lit("INVALID_URL"))
        .when(~parts["scheme"].isin("http", "https"), F.lit("UNSUPPORTED_SCHEME"))
        .when(F.contains(parts["authority"], F.lit("@")), F.lit("EMBEDDED_CREDENTIALS"))
    )


def _form_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _clean_query(query: Column) -> Column:
    """Tracking parameters out, the rest sorted by name, kept in order within one name."""
    pieces = F.filter(F.split(F.regexp_replace(query, "^[?]", ""), "&"), lambda piece: piece != "")
    pairs = F.transform(
        pieces,
        lambda piece, index: F.struct(
            _form_decode(F.substring_index(piece, "=", 1)).alias("name"),
            index.alias("index"),
            _form_decode(F.regexp_replace(piece, "^[^=]*=?", "")).alias("value"),
        ),
    )

    def kept(pair: Column, listed: Column) -> Column:
        first = F.filter(listed, lambda other: other["name"] == pair["name"])[0]["value"]
        return let(
            F.lower(pair["name"]),
            lambda name: ~(
                F.startswith(name, F.lit(TRACKING_PREFIX))
                | name.isin(TRACKING_KEYS)
                | ((name == FEED_STAMP_KEY) & F.startswith(F.lower(first), F.lit(FEED_STAMP_VALUE)))
            ),
        )

    ordered = let(pairs, lambda listed: F.array_sort(F.filter(listed, lambda pair: kept(pair, listed))))
    return F.array_join(
        F.transform(ordered, lambda pair: F.concat(F.url_encode(pair["name"]), F.lit("="), F.url_encode(pair["value"]))),
        "&",
    )


def _prefixed(mark: str, part: Column) -> Column:
    return F.when(part == "", F.lit("")).otherwise(F.concat(F.lit(mark), part))


def _rebuilt(parts: Column) -> Column:
    port = F.regexp_extract(parts["authority"], r":(\d+)$", 1)
    default_port = F.when(parts["scheme"] == "https", F.lit("443")).otherwise(F.lit("80"))
    folded = F.regexp_replace(F.concat(F.lit("/"), parts["path"]), "/{2,}", "/")
    query = F.when(parts["query"] == "", F.lit("")).otherwise(_clean_query(parts["query"]))
    return F.concat(
        parts["scheme"],
        F.lit("://"),
        _host(parts["authority"]),
        let(port, lambda p: _prefixed(":", F.when(p == default_port, F.lit("")).otherwise(p))),
        let(folded, lambda path: F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))),
        let(query, lambda q: _prefixed("?", q)),
    )


def canonical_url(url: Column) -> Column:
    """One spelling per article link; null for links that :func:`link_error` names."""
    return let(_parts(url), lambda parts: F.when(_error(parts).isNull(), _rebuilt(parts)))


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def dedupe_key(url: Column) -> Column:
    """Stored link without the feed stamp, so that stamped and clean rows meet."""
    unstamped = F.regexp_replace(url, r"([?&])source=rss[^&]*(&|$)", "$1")
    return F.regexp_replace(unstamped, r"[?&]+$", "")


# Address blocks that are not public.
_PRIVATE_V4 = (
    r"^(0|10|127)\.|^(22[4-9]|2[3-9]\d|[3-9]\d\d)\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."
    r"|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.0\.[02]\.|^192\.168\.|^198\.1[89]\."
)
_PRIVATE_V6 = r"^\[?(::|::1|f[cd].*|fe[89ab].*)\]?$"


def is_public_host(host: Column) -> Column:
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    v6 = F.contains(host, F.lit(":"))
    private = (
        (host == "localhost")
        | F.endswith(host, F.lit(".local"))
        | (v4 & host.rlike(_PRIVATE_V4))
        | (v6 & host.rlike(_PRIVATE_V6))
    )
    return host.isNotNull() & ~private


def resolve_link(link: Column, base: Column) -> Column:
    """Absolute form of a link found on a page."""
    value = trimmed(link)
    origin = F.concat(scheme(base), F.lit("://"), F.lower(_part(base, 2)))
    folder = F.concat(origin, F.regexp_replace(F.regexp_replace(_part(base, 3), "[^/]*$", ""), "^$", "/"))
    return (
        F.when(value.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), value)
        .when(F.startswith(value, F.lit("//")), F.concat(scheme(base), F.lit(":"), value))
        .when(F.startswith(value, F.lit("/")), F.concat(origin, value))
        .when(value != "", F.concat(folder, value))
    )


# What a safe image address may not look like.
IMAGE_URL_CHARS = 2048
PLACEHOLDER_IMAGE_PATTERNS = [
    r"/da:true/",
    r"(?i)(?:^|/)(?:1x1|pixel|spacer|blank)\.(?:gif|png|jpg)(?:$|\?)",
    r"(?i)/stat\?event=",
]
MIN_IMAGE_WIDTH = 200


def is_placeholder_image(url: Column) -> Column:
    hit = F.lit(False)
    for pattern in PLACEHOLDER_IMAGE_PATTERNS:
        hit = hit | url.rlike(pattern)
    width = F.regexp_extract(url, r"resize:(?:fit|fill):(\d+)", 1)
    return hit | F.coalesce(width.try_cast("bigint") < MIN_IMAGE_WIDTH, F.lit(False))


def safe_image_url(url: Column, base: Column | None = None) -> Column:
    """The image address when it may be shown, else null."""

    def checked(raw: Column) -> Column:
        resolved = raw if base is None else resolve_link(raw, base)
        return F.when(F.length(raw).between(1, IMAGE_URL_CHARS), let(resolved, shown))

    def shown(resolved: Column) -> Column:
        ok = let(
            _parts(resolved),
            lambda parts: (F.length(resolved) <= IMAGE_URL_CHARS)
            & (parts["scheme"] == "https")
            & ~F.contains(parts["authority"], F.lit("@"))
            & let(_host(parts["authority"]), is_public_host),
        )
        return F.when(ok & ~is_placeholder_image(resolved), resolved)

    return let(trimmed(url), checked)


# Hosts whose images the page-engagement reader trusts.
TRUSTED_IMAGE_HOSTS = ["cdn-images-1.medium.com", "miro.medium.com", "medium.com"]


def trusted_image_url(url: Column) -> Column:
    host = host_of(url)
    known = F.lit(False)
    for name in TRUSTED_IMAGE_HOSTS:
        known = known | (host == name) | F.endswith(host, F.lit("." + name))
    return F.when((scheme(url) == "https") & known & ~is_placeholder_image(trimmed(url)), trimmed(url))


def narrowed_image_url(url: Column, width: int) -> Column:
    """Ask the image host for the width that is shown; never a larger one."""
    target = max(1, round(width))
    by_path = F.regexp_extract(url, r"/max/(\d+)/", 1)
    by_resize = F.regexp_extract(url, r"resize:(?:fit|fill):(\d+)", 1)
    return (
        F.when((by_path != "") & (by_path.try_cast("decimal(38,0)") <= target), url)
        .when(by_path != "", F.regexp_replace(url, r"/max/\d+/", f"/max/{target}/"))
        .when((by_resize != "") & (by_resize.try_cast("decimal(38,0)") <= target), url)
        .when(by_resize != "", F.regexp_replace(url, r"resize:(fit|fill):\d+", f"resize:$1:{target}"))
        .otherwise(url)
    )

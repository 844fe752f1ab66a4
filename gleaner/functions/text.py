"""Column expressions for tokens, shingles, markup and whitespace."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as ECMAScript defines it (wider than Java's \\s).
WHITESPACE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# The same as a regex class; the rare wide characters sit behind one range test.
SPACE = r"[\t\n\x0B\f\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"

# Named entities that are decoded; every other name is kept as text.
# "amp" comes last: what it yields may only be read again on the next pass.
NAMED_ENTITIES = {
    "nbsp": " ",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "ldquo": "“",
    "rdquo": "”",
    "lsquo": "‘",
    "rsquo": "’",
    "hellip": "…",
    "mdash": "—",
    "ndash": "–",
    "middot": "·",
    "trade": "™",
    "amp": "&",
}
DECODE_PASSES = 3

@dataclass(frozen=True)
class TextLimits:
    """Most characters of each part of a candidate, and most entries of a payload; by default everything is kept."""

    title: int | None = None
    author: int | None = None
    summary: int | None = None
    short_summary: int | None = None
    body: int | None = None
    meta: int | None = None
    entries: int | None = None


NO_LIMITS = TextLimits()

# The limits of a request that has a time budget.
REQUEST_LIMITS = TextLimits(title=500, author=250, summary=1_200, short_summary=400, body=20_000, meta=2_000, entries=50)


def cut(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times.

    A plain expression would be copied into every place that mentions it, and
    inside a lambda it would even be evaluated once per array element.
    """
    return F.transform(F.array(value), use)[0]


def any_of(text: Column, phrases: Sequence[str]) -> Column:
    """Does the text contain one of the phrases?"""
    return let(text, lambda t: reduce(operator.or_, [F.contains(t, F.lit(phrase)) for phrase in phrases]))


def array_of_strings() -> Column:
    return F.array().cast("array<string>")


def find_all(text: Column, pattern: str) -> Column:
    """Every match of the first group of ``pattern``; empty for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), array_of_strings())


def words(text: Column) -> Column:
    """Lower-cased ASCII words as titles and bodies are tokenised."""
    return find_all(F.lower(text), r"([a-z0-9.+#/-]+)")


# The only characters outside ASCII whose lower case holds an ASCII letter.
LOWERED_TO_ASCII = "\u0130\u212a"


def word_total(text: Column) -> Column:
    """Number of ``words``; a text is only lowered where that changes more than the case of its letters."""

    def counted(value: Column) -> Column:
        special = reduce(operator.or_, [F.contains(value, F.lit(char)) for char in LOWERED_TO_ASCII])
        lowered = F.regexp_count(F.lower(value), F.lit("[a-z0-9.+#/-]+"))
        return F.when(special, lowered).otherwise(F.regexp_count(value, F.lit("[A-Za-z0-9.+#/-]+")))

    return F.coalesce(let(text, counted), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def collapse(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed, empty to null."""
    return F.nullif(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")), F.lit(""))


def clean_text(text: Column, limit: int | None = None) -> Column:
    return cut(collapse(text), limit)


def shingles(title: Column) -> Column:
    """Distinct word bigrams; the single word itself when there is only one."""


    def paired(tokens: Column) -> Column:
        count = F.size(tokens)
        pairs = F.zip_with(
            F.slice(tokens, F.lit(1), count - 1),
            F.slice(tokens, F.lit(2), count - 1),
            lambda left, right: F.concat(left, F.lit(" "), right),
        )
        return F.array_distinct(F.when(count < 2, tokens).otherwise(pairs))

    return let(words(title), paired)


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two duplicate-free arrays, 0 when either is empty."""
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        let(F.size(F.array_intersect(left, right)), lambda shared: shared / (F.size(left) + F.size(right) - shared)),
    ).otherwise(F.lit(0.0))


def _code_point_char(code: Column) -> Column:
    """Character of a code point, null where none may be written (surrogates, out of range)."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    encoded = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(valid, F.decode(encoded, "UTF-32"))


def _replace_numeric(text: Column, pattern: str, code_of) -> Column:
    return let(text, lambda value: F.aggregate(
        F.array_distinct(find_all(value, pattern)),
        value,
        lambda acc, entity: F.replace(acc, entity, F.coalesce(let(code_of(entity), _code_point_char), entity)),
    ))


def decode_entities_once(text: Column) -> Column:
    named = reduce(
        lambda acc, item: F.regexp_replace(acc, f"(?i)&{item[0]};", item[1]),
        NAMED_ENTITIES.items(),
        text,
    )
    hexed = _replace_numeric(
        named,
        r"(&#[xX][0-9a-fA-F]+;)",
        lambda e: F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10).try_cast("bigint"),
    )
    return _replace_numeric(
        hexed,
        r"(&#[0-9]+;)",
        lambda e: F.regexp_extract(e, "([0-9]+);", 1).try_cast("bigint"),
    )


def decode_entities(text: Column) -> Column:
    """Decode up to three layers of escaping; text without ``&`` skips the work."""


    def decoded(value: Column, passes: int) -> Column:
        if not passes:
            return value
        again = let(decode_entities_once(value), lambda once: decoded(once, passes - 1))
        return F.when(value.rlike("&[A-Za-z#]"), again).otherwise(value)

    return let(text, lambda value: decoded(value, DECODE_PASSES))


def plain_text(markup: Column, limit: int | None = None) -> Column:
    """Feed markup as text: tags go first so that a decoded ``<`` stays a character."""
    return cut(collapse(decode_entities(F.regexp_replace(markup, "<[^>]*>", " "))), limit)


def strip_markup(markup: Column, limit: int | None = None) -> Column:
    """Like :func:`plain_text`, dropping fenced code and Markdown images before the tags."""
    fenced = F.regexp_replace(markup, "(?s)```.*?```", " ")
    images = F.regexp_replace(fenced, r"!\[[^\]]*\]\([^)]*\)", " ")
    return plain_text(images, limit)


# Formats of a feed date after its weekday is taken off, tried in this order.
DATE_FORMATS = [
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm Z",
    "d MMM yyyy HH:mm z",
    "d MMM yyyy",
]


def any_date(text: Column) -> Column:
    """ISO or RFC-822 date; null when unreadable."""

    def read(value: Column) -> Column:
        bare = F.regexp_replace(value, r"^[A-Za-z]{3,9},?\s+", "")
        return F.coalesce(
            value.try_cast("timestamp"),
            *[F.try_to_timestamp(bare, F.lit(fmt)) for fmt in DATE_FORMATS],
        )

    return let(blank_to_null(text), read)


# Bylines that name nobody.
PLACEHOLDER_AUTHORS = ["unknown author", "unknown", "n/a", "na", "anonymous", "—", "-", "undefined", "null"]


def is_real_author(author: Column) -> Column:
    named = let(F.lower(trimmed(author)), lambda name: (name != "") & ~name.isin(PLACEHOLDER_AUTHORS))
    return F.coalesce(named, F.lit(False))

"""Extractive key points: the sentences of an article that say most about it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import SPACE, any_of, array_of_strings, find_all, let, trimmed

# Weights of a sentence's score and the sizes a sentence may have.
INFORMATIVE, POSITION, SUBJECT, FIGURE = 0.4, 0.3, 0.2, 0.1
MIN_SENTENCE_WORDS, MAX_SENTENCE_WORDS = 8, 60
MIN_WORD_CHARS = 3
DEFAULT_POINTS, MOST_POINTS = 4, 8
CARD_POINTS_MAX, CARD_POINTS_MIN = 5, 3

# Page furniture that is never a key point.
BOILERPLATE = [
    "continue reading on",
    "appeared first on",
    "read more",
    "subscribe",
    "sign up",
    "follow us",
    "originally published",
    "photo by",
    "image credit",
    "click here",
    "share this",
    "all rights reserved",
    "cookie",
    "newsletter",
    "press enter or click",
    "view image in full size",
    "min read",
    "listen to this story",
    "member-only story",
    "sign in to",
    "open in app",
]

# Words that say nothing about a sentence's subject.
STOPWORDS = [
    "the", "and", "for", "that", "with", "this", "from", "you", "your", "are", "was", "were",
    "have", "has", "had", "not", "but", "can", "will", "how", "what", "when", "which", "they",
    "their", "its", "it", "is", "of", "to", "in", "on", "at", "by", "we", "our",
    "as", "an", "be", "or", "if", "a", "i", "us", "so", "do", "does", "did",
    "been", "more", "than", "then", "there", "these", "those", "also", "just", "about", "into", "over",
    "some", "any", "all",
]

# Sentence boundary, word, proper ending and glued page furniture.
BOUNDARY = r"(?<=[.!?])(?:\s+|(?=[A-Z][a-z]))(?=[A-Z0-9\"'“])"
WORD = r"([a-z0-9][a-z0-9'.+#-]*)"
ENDING = r"[.!?][\"'”’]?$"
ORDINAL = r"(?i)\d+(st|nd|rd|th|s)"
GLUED = r"(?i)[a-z]\d|\d[a-z]{3,}"

# Scores are ranked at this many decimals so that the order of a sum cannot decide.
SCORE_DECIMALS = 9


def sentences(text: Column) -> Column:
    pieces = F.split(F.regexp_replace(text, f"{SPACE}+", " "), BOUNDARY)
    return F.filter(F.transform(pieces, trimmed), lambda piece: piece != "")


def _judged(sentence: Column, index: Column) -> Column:
    """What a usable sentence is scored by; null for another one. Cheap tests come first, each text is lowered once."""
    figure = sentence.rlike("[0-9]")
    glued = figure & F.regexp_replace(sentence, ORDINAL, "").rlike(GLUED)  # both glued forms hold a digit

    def by_words(lower: Column, found: Column) -> Column:
        usable = F.size(found).between(MIN_SENTENCE_WORDS, MAX_SENTENCE_WORDS) & ~any_of(lower, BOILERPLATE) & ~glued
        judged = F.struct(
            index.alias("index"),
            F.exists("aliases", lambda alias: F.contains(lower, alias)).cast("int").alias("subject"),
            figure.cast("int").alias("figure"),
            F.filter(found, lambda word: ~word.isin(STOPWORDS) & (F.length(word) >= MIN_WORD_CHARS)).alias("tokens"),
        )
        return F.when(usable, judged)

    def by_letters(lower: Column) -> Column:
        return let(find_all(lower, WORD), lambda found: by_words(lower, found))

    return F.when(sentence.rlike(ENDING), let(F.lower(sentence), by_letters))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def informativeness(tokens: pa.Array) -> pa.Array:
    """For each sentence of each text: the mean of its distinct words' frequencies, as shares of the text's highest.

    tokens: per text an array of sentences, each an array of words. A sentence without words has 0.
    """
    texts = len(tokens)
    sentences_of = np.diff(np.asarray(tokens.offsets))
    sentence = tokens.flatten()
    words_of = np.diff(np.asarray(sentence.offsets)) if len(sentence) else np.zeros(0, dtype=np.int32)
    word = sentence.flatten().dictionary_encode()
    codes, kinds = np.asarray(word.indices, dtype=np.int64), max(1, len(word.dictionary))
    at = np.repeat(np.arange(len(words_of)), words_of)
    text_of = np.repeat(np.arange(texts), sentences_of)
    _, place, uses = np.unique(text_of[at] * kinds + codes, return_inverse=True, return_counts=True)
    frequency = uses[place]
    peak = np.ones(texts, dtype=np.int64)
    np.maximum.at(peak, text_of[at], frequency)
    _, once = np.unique(at * kinds + codes, return_index=True)
    share = frequency[once] / peak[text_of[at[once]]]
    total = np.bincount(at[once], weights=share, minlength=len(words_of))
    count = np.bincount(at[once], minlength=len(words_of))
    mean = np.divide(total, count, out=np.zeros(len(words_of)), where=count > 0)
    offsets = np.concatenate(([0], np.cumsum(sentences_of))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(mean))


def key_points(
    items: DataFrame, most: int = DEFAULT_POINTS, body_col: str = "body_content", aliases_col: str | None = None
) -> DataFrame:
    """(id, points): up to ``most`` verbatim sentences per item in text order.

    Everything happens in the row of the text, where it is scanned: nothing is shuffled.
    Words are counted by text in Arrow batches, in time proportional to the text.
    """
    most = max(1, min(most, MOST_POINTS))
    aliases = F.transform(F.col(aliases_col), F.lower) if aliases_col else array_of_strings()
    read = items.filter(F.col(body_col).isNotNull())
    cut = read.select("id", sentences(F.col(body_col)).alias("sentences"), aliases.alias("aliases"))
    usable = cut.withColumn("usable", F.filter(F.transform("sentences", _judged), lambda entry: entry.isNotNull()))
    # Not deterministic for the optimizer, which else copies the call into filters and lambdas. Texts without a usable
    # sentence go after it: a filter before it would be moved to the scan and judge every sentence twice.
    rated = usable.withColumn("info", informativeness.asNondeterministic()(F.transform("usable", lambda entry: entry["tokens"])))
    rated = rated.filter(F.size("usable") > 0)

    def score(pair: Column) -> Column:
        entry = pair["usable"]
        total = (
            pair["info"] * INFORMATIVE
            + (F.lit(1.0) - entry["index"] / F.size("sentences")) * POSITION
            + entry["subject"] * SUBJECT
            + entry["figure"] * FIGURE
        )
        return F.struct((-F.round(total, SCORE_DECIMALS)).alias("order"), entry["index"].alias("index"))

    best = F.slice(F.array_sort(F.transform(F.arrays_zip("usable", "info"), score)), 1, most)
    chosen = F.array_sort(F.transform(best, lambda entry: entry["index"]))
    return rated.select("id", F.transform(chosen, lambda index: F.get(F.col("sentences"), index)).alias("points"))


def card_key_points(page: DataFrame, items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Key points for the rows of a feed page; fewer than three are dropped.

    ``page`` holds item ids, ``aliases`` (id, aliases) the names of each card's
    topics. Only the page's bodies are read into the summary.
    """
    bodies = items.select("id", "body_content").join(page.select("id").distinct(), "id", "left_semi")
    if aliases is None:
        points = key_points(bodies, CARD_POINTS_MAX)
    else:
        named = bodies.join(aliases, "id", "left").withColumn("aliases", F.coalesce("aliases", array_of_strings()))
        points = key_points(named, CARD_POINTS_MAX, aliases_col="aliases")
    return points.filter(F.size("points") >= CARD_POINTS_MIN)

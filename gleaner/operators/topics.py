"""Topic classification with a dictionary table of aliases.

Up to ``INLINE_BYTES`` of aliases the dictionary is one array value (a scalar subquery
over the alias table), so a row meets all aliases in place: no shuffle and no product of
rows. The size is measured. A larger dictionary is joined: each alias by its rarest run
of three letters, and what has that run is tested for the alias itself, so work follows
the texts and what they hold, not texts times aliases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.language import full_text
from gleaner.functions.scoring import iff
from gleaner.functions.text import let
from gleaner.session import settled

# Confidence of a match and how many topics an item keeps.
BASE_CONFIDENCE, STEP_CONFIDENCE = 0.55, 0.15
TOPICS_PER_ITEM = 3
# Aliases up to this size are an array on each row; probes up to this size are broadcast.
INLINE_BYTES = 64 << 10
PROBE_BYTES = 64 << 20
RUN, LETTER_BITS = 3, 21

# A mention in the title is worth this many in the summary.
TITLE_MENTION = 3

# Keywords per topic, in topic order.
DEFAULT_TOPIC_KEYWORDS = {
    "OpenAI": ["openai", "chatgpt", "gpt-", "codex", "sora"],
    "Hugging Face": ["hugging face", "huggingface", "transformers", "spaces"],
    "NVIDIA": ["nvidia", "cuda", "geforce", "dgx"],
    "Google / Google DeepMind": ["google", "deepmind", "gemini", "tensorflow"],
    "Vercel": ["vercel", "turbopack", "ai sdk"],
    "Supabase": ["supabase"],
    "Resend": ["resend"],
    "Next.js": ["next.js", "nextjs"],
    "React": ["react", "reactjs"],
    "TypeScript": ["typescript", "tsconfig"],
    "GitHub": ["github", "github actions", "github copilot"],
    "Neon": ["neon", "neon postgres"],
}


def default_dictionary(spark) -> DataFrame:
    """The built-in topic dictionary as a table (topic_id, name, alias)."""
    rows = [
        (index, name, alias)
        for index, (name, aliases) in enumerate(DEFAULT_TOPIC_KEYWORDS.items())
        for alias in aliases
    ]
    return spark.createDataFrame(rows, "topic_id bigint, name string, alias string")


def dictionary_value(topic_aliases: DataFrame) -> Column:
    """array<struct<topic_id, aliases>> ordered by topic."""
    per_topic = topic_aliases.groupBy("topic_id").agg(F.collect_set(F.lower("alias")).alias("aliases"))
    return per_topic.agg(F.array_sort(F.collect_list(F.struct("topic_id", "aliases")))).scalar()


def classified(items: DataFrame, topic_aliases: DataFrame) -> DataFrame:
    """Adds matches: array<struct<topic_id, hits, confidence>>, best three first."""
    haystack = F.lower(full_text(F.col("title"), F.col("summary"), F.col("body_content")))

    def counted(entry: Column, text: Column) -> Column:
        return let(
            F.size(F.filter(entry["aliases"], lambda alias: F.contains(text, alias))),
            lambda hits: F.struct(
                (-F.least(F.lit(1.0), F.lit(BASE_CONFIDENCE) + hits * F.lit(STEP_CONFIDENCE))).alias("order"),
                entry["topic_id"].alias("topic_id"),
                hits.alias("hits"),
            ),
        )

    def ranked(text: Column) -> Column:
        found = F.transform(F.col("dictionary"), lambda entry: counted(entry, text))
        return F.array_sort(F.filter(found, lambda entry: entry["hits"] > 0))

    matches = F.transform(
        F.slice(let(haystack, ranked), 1, TOPICS_PER_ITEM),
        lambda entry: F.struct(entry["topic_id"].alias("topic_id"), entry["hits"].alias("hits"), (-entry["order"]).alias("confidence")),
    )
    return items.withColumn("dictionary", dictionary_value(topic_aliases)).withColumn("matches", matches).drop("dictionary")


def _bytes_of(rows: DataFrame, *columns: str) -> int:
    total = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in columns), F.lit(0))
    return rows.agg(F.sum(total).alias("bytes")).first()["bytes"] or 0


@F.arrow_udf(T.ArrayType(T.LongType()))
def letter_runs(texts: pa.Array, sizes: pa.Array) -> pa.Array:
    """Distinct runs of so many letters (up to 3) of each text; a run is a number, 21 bits a letter."""
    found = []
    for text, size in zip(texts, sizes, strict=True):
        letters = np.frombuffer((text.as_py() or "").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        size = size.as_py()
        last = max(0, len(letters) - size + 1)
        codes = np.zeros(last, dtype=np.int64)
        for k in range(size):
            codes = codes << LETTER_BITS | letters[k : k + last]
        found.append(np.unique(codes))
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found])))


def matched_aliases(texts: DataFrame, aliases: DataFrame, probe_bytes: int = PROBE_BYTES) -> DataFrame:
    """(id, alias): every alias that a text contains. texts: (id, text); aliases: (alias).

    Runs of the dictionary are counted in the texts, and the rarest run of each alias
    probes them; candidates meet their text again and are tested with ``contains``. The
    probes are broadcast if their measured size allows it and joined by run otherwise.
    """
    listed = aliases.select("alias").filter(F.col("alias") != "").distinct()
    listed = settled(listed.withColumn("size", F.least(F.length("alias"), F.lit(RUN))))
    sizes = sorted(row["size"] for row in listed.select("size").distinct().collect())  # 1 to RUN

    def by_size(rows: DataFrame, text: str, *keep: str) -> DataFrame | None:
        out = None
        for size in sizes:
            own = rows.filter(F.col("size") == size) if "size" in rows.columns else rows
            # Not deterministic for the optimizer, which else may evaluate the call twice.
            runs = own.select(*keep, letter_runs.asNondeterministic()(F.col(text), F.lit(size)).alias("runs"))
            part = runs.select(*keep, F.explode("runs").alias("run"))
            out = part if out is None else out.unionByName(part)
        return out

    def probed(rows: DataFrame, probes: DataFrame) -> DataFrame:
        small = _bytes_of(probes.withColumn("run", F.col("run").cast("string")), *probes.columns) <= probe_bytes
        return rows.join(F.broadcast(probes) if small else probes, "run")

    if not sizes:
        return texts.select("id", F.lit("").alias("alias")).filter("false")
    own = settled(by_size(listed, "alias", "alias"))
    in_texts = by_size(texts, "text", "id")
    counts = probed(in_texts, settled(own.select("run").distinct())).groupBy("run").agg(F.count(F.lit(1)).alias("found"))
    rarest = (
        own.join(counts, "run", "left")
        .groupBy("alias")
        .agg(F.min(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "run")).alias("rarest"))
        .filter("rarest.found > 0")
    )
    probes = settled(rarest.select("alias", F.col("rarest.run").alias("run")))
    candidates = probed(in_texts, probes).select("id", "alias").distinct()
    return candidates.join(texts, "id").filter(F.contains("text", F.col("alias"))).select("id", "alias")


def _lowered(topic_aliases: DataFrame) -> DataFrame:
    return topic_aliases.select("topic_id", F.lower("alias").alias("alias")).distinct()


def _classified_by_join(items: DataFrame, topic_aliases: DataFrame) -> DataFrame:
    text = F.lower(full_text(F.col("title"), F.col("summary"), F.col("body_content")))
    dictionary = _lowered(topic_aliases)
    found = matched_aliases(items.select("id", text.alias("text")), dictionary)
    hits = found.join(dictionary, "alias").groupBy("id", "topic_id").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    sure = hits.withColumn("confidence", F.least(F.lit(1.0), F.lit(BASE_CONFIDENCE) + F.col("hits") * F.lit(STEP_CONFIDENCE)))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "topic_id"))
    return sure.withColumn("place", place).filter(F.col("place") <= TOPICS_PER_ITEM).drop("place")


def classify(items: DataFrame, topic_aliases: DataFrame, inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """(id, topic_id, hits, confidence), at most three topics per item."""
    if _bytes_of(topic_aliases, "alias") > inline_bytes:
        return _classified_by_join(items, topic_aliases).select("id", "topic_id", "hits", "confidence")
    return classified(items, topic_aliases).select("id", F.inline("matches"))


def link_topics(
    items: DataFrame, source_topics: DataFrame | None, matches: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Union of the source's topics and the matched ones; only new links if existing are given."""
    links = matches.select(F.col("id").alias("item_id"), "topic_id")
    if source_topics is not None:
        declared = items.select("id", "source_id").join(source_topics, "source_id")
        links = links.unionByName(declared.select(F.col("id").alias("item_id"), "topic_id"))
    links = links.distinct()
    return links if existing is None else links.join(existing, ["item_id", "topic_id"], "left_anti")


def _occurrences(text: Column, needle: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def _leading_by_join(items: DataFrame, topic_aliases: DataFrame, summary_col: str) -> DataFrame:
    title, summary = F.lower("title"), F.lower(F.coalesce(summary_col, F.lit("")))
    # The line break keeps an alias from matching across the two.
    texts = items.select("id", F.concat_ws("\n", title, summary).alias("text"))
    dictionary = _lowered(topic_aliases)
    found = matched_aliases(texts, dictionary).join(items.select("id", title.alias("title"), summary.alias("summary")), "id")
    weight = F.coalesce(_occurrences(F.col("title"), F.col("alias")), F.lit(0)) * TITLE_MENTION + _occurrences(F.col("summary"), F.col("alias"))
    weights = found.select("id", "alias", weight.alias("weight")).join(dictionary, "alias")
    weights = weights.groupBy("id", "topic_id").agg(F.sum("weight").cast("int").alias("weight")).filter("weight > 0")
    order = F.struct("weight", (-F.col("topic_id")).alias("order"))
    best = weights.groupBy("id").agg(F.max("weight").alias("leading_weight"), F.array_sort(F.collect_list(order)).alias("all"))
    lead = F.transform(F.filter("all", lambda entry: entry["weight"] == F.col("leading_weight")), lambda entry: -entry["order"])
    led = best.select("id", F.array_sort(lead).alias("leading_topics"), "leading_weight")
    none = F.array().cast(led.schema["leading_topics"].dataType)
    return items.join(led, "id", "left").withColumns(
        {"leading_topics": F.coalesce("leading_topics", none), "leading_weight": F.coalesce("leading_weight", F.lit(0))}
    )


def leading_topics(
    items: DataFrame, topic_aliases: DataFrame, summary_col: str = "summary", inline_bytes: int = INLINE_BYTES
) -> DataFrame:
    """Adds leading_topics: the topics mentioned most in title and summary, ties included."""
    if _bytes_of(topic_aliases, "alias") > inline_bytes:
        return _leading_by_join(items, topic_aliases, summary_col)
    texts = F.struct(F.lower("title").alias("title"), F.lower(F.coalesce(summary_col, F.lit(""))).alias("summary"))

    def weighed(entry: Column, text: Column) -> Column:
        weight = F.aggregate(
            entry["aliases"],
            F.lit(0),
            lambda acc, alias: acc
            + _occurrences(text["title"], alias) * TITLE_MENTION
            + _occurrences(text["summary"], alias),
        )
        return F.struct(entry["topic_id"].alias("topic_id"), weight.alias("weight"))

    def leading(weights: Column) -> Column:
        best = F.coalesce(F.array_max(F.transform(weights, lambda entry: entry["weight"])), F.lit(0))
        return let(
            best,
            lambda most: F.struct(
                F.transform(
                    F.filter(weights, lambda entry: (entry["weight"] == most) & (most > 0)), lambda entry: entry["topic_id"]
                ).alias("topics"),
                most.alias("weight"),
            ),
        )

    weights = let(texts, lambda text: F.transform(F.col("dictionary"), lambda entry: weighed(entry, text)))
    return (
        items.withColumn("dictionary", dictionary_value(topic_aliases))
        .withColumn("lead", let(weights, leading))
        .withColumn("leading_topics", F.col("lead.topics"))
        .withColumn("leading_weight", F.col("lead.weight"))
        .drop("dictionary", "lead")
    )


def subject(leading: Column, stored: Column) -> Column:
    """Topics an item is about: the leading ones, or its stored links when the text names none."""
    return F.when(F.size(leading) > 0, leading).otherwise(stored)


def covers(about: Column, followed: Column) -> Column:
    """A topic the item is about is followed; a reader without a selection sees everything."""
    return (F.size(followed) == 0) | iff(F.arrays_overlap(about, followed))


def followed_first(stored: Column, followed: Column) -> Column:
    return F.concat(
        F.filter(stored, lambda topic: F.array_contains(followed, topic)),
        F.filter(stored, lambda topic: ~F.array_contains(followed, topic)),
    )


def match_followed(pairs: DataFrame) -> DataFrame:
    """Keep (reader, item) rows the reader's topics lead; order topics followed-first."""
    kept = pairs.filter(covers(subject(F.col("leading_topics"), F.col("topics")), F.col("followed")))
    return kept.withColumn("topics", followed_first(F.col("topics"), F.col("followed")))

"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` words (a shorter item is one window).
A window is a set of positioned shingles of three words. Its shingles are ordered by
rarity in the documents; a document that contains the window contains its rarest
shingle, so a prefix of one shingle is all the join needs. The match fixes where the
window would begin (positional bound) and it must fit into the document (length
bound). Surviving candidates are compared word for word with the document.

The documents are scanned once for all benchmark shingles: an exploded stream of
(document, position, 64-bit shingle hash) meets the benchmark's shingles; Spark
broadcasts those if they are small and sorts both sides otherwise. Only hits are
written, and rarity, prefixes and candidates all come from them. Texts meet
candidates, grouped by document, in one join for the exact test.

Windows of one or two words have no shingle of three; for them, and only if there are
any, words or pairs are scanned the same way.

Defined results: a null text has no words; an item without words has no window. Rows
with a null doc_id are judged with the others of their text. Rows that repeat an id are
judged each on its own text. Items that repeat an id count as one; items with a null id
hit words, and are not among the items counted. Without documents or items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.storage import Shelf

WINDOW = 10
SHINGLE = 3

# Fixed value: a word is a run of these.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in order, A-Z lower-cased; no words for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words): every window of every item."""
    split = items.select("item_id", words_of(F.col("text")).alias("all")).filter("size(all) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    return split.select("item_id", "all", F.explode(starts).alias("at")).select(
        "item_id", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words")
    )


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window_id, n, offset, shingle) for each place of a window; size is the shingle's words."""
    size = F.least(F.col("n"), F.lit(SHINGLE))
    places = windows.select(
        "window_id", "n", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("offset")
    )
    hashes = F.when(F.col("size") == 1, _shingle(F.col("words"), F.col("offset"), 1))
    for k in range(2, SHINGLE + 1):
        hashes = hashes.when(F.col("size") == k, _shingle(F.col("words"), F.col("offset"), k))
    return places.select("window_id", "n", "size", "offset", hashes.alias("shingle"))


def _hits(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, at, size, shingle): places of documents that hold a benchmark shingle of this size."""

    def hashes(words: Column) -> Column:
        whole = F.slice(words, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))
        return F.transform(whole, lambda _, i: _shingle(words, i, size))

    placed = docs.select("key", F.posexplode(let(words_of(F.col("text")), hashes)).alias("at", "shingle"))
    own = wanted.filter(F.col("size") == size).select("shingle").distinct()
    return placed.join(own, "shingle").select("key", "at", F.lit(size).alias("size"), "shingle")


def findings(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, key, n_words, n_hit, windows) of every row, and (window_id, item_id)."""
    shelf = Shelf(docs.sparkSession, "decontamination")
    rows = item_windows(benchmark.select("item_id", "text"), window)
    rows = rows.withColumns({"window_id": F.sha2(F.array_join("words", " "), 256), "n": F.size("words")})
    windows = shelf.put("windows", rows.groupBy("window_id", "n").agg(F.first("words").alias("words")))
    owners = shelf.put("owners", rows.select("window_id", "item_id").distinct())
    shingles = shelf.put("shingles", _window_shingles(windows))

    texts = docs.select("doc_id", "text", F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("key"))
    sizes = [row["size"] for row in shingles.select("size").distinct().collect()]  # 1, 2, 3 at most
    found = None
    for size in sorted(sizes):
        part = _hits(texts, shingles, size)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.select("key", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("shingle"))
        found = found.filter("false")
    hits = shelf.put("hits", found)

    rarity = hits.groupBy("size", "shingle").agg(F.count(F.lit(1)).alias("places"))
    ranked = shingles.join(rarity, ["size", "shingle"], "left")
    # A window whose rarest shingle occurs nowhere has no candidates.
    rarest = F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "offset", "shingle")).alias("rarest")
    prefixes = (
        ranked.groupBy("window_id", "n", "size")
        .agg(rarest)
        .filter("rarest.places > 0")
        .select("window_id", "n", "size", F.col("rarest.offset").alias("offset"), F.col("rarest.shingle").alias("shingle"))
    )
    prefixes = shelf.put("prefixes", prefixes)
    start = F.col("at") - F.col("offset")
    candidates = (
        hits.join(prefixes, ["size", "shingle"])
        .select("key", start.alias("start"), "n", "window_id")
        .filter("start >= 0")
        .join(windows.select("window_id", "words"), "window_id")
    )
    by_doc = candidates.groupBy("key").agg(
        F.collect_set(F.struct("start", "n", "window_id", "words")).alias("candidates")
    )

    def found_in(words: Column) -> Column:
        fits = F.filter(F.coalesce("candidates", F.array()), lambda c: c["start"] + c["n"] <= F.size(words))
        same = F.filter(fits, lambda c: F.slice(words, c["start"] + 1, c["n"]) == c["words"])
        return F.struct(F.size(words).cast("long").alias("n_words"), same.alias("hit"))

    spans = F.transform("found.hit", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))
    judged = (
        texts.join(by_doc, "key", "left")
        .select("doc_id", "key", let(words_of(F.col("text")), found_in).alias("found"))
        .select(
            "doc_id",
            "key",
            "found.n_words",
            F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("found.hit", lambda c: c["window_id"])).alias("windows"),
        )
    )
    return shelf.put("judged", judged), owners


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    judged, owners = findings(docs, benchmark, window)
    items = (
        judged.select("key", F.explode("windows").alias("window_id"))
        .join(owners, "window_id")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        judged.join(items, "key", "left")
        .withColumn("items", F.coalesce("items", none))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window."""
    judged, _ = findings(docs, benchmark, window)
    bad = judged.filter("n_hit > 0").select(F.col("key").alias("_bad"))
    own = F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"))
    return docs.join(bad, own.eqNullSafe(bad["_bad"]), "left_anti")


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark),
wanted AS (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0)
),
places AS (
    SELECT doc_id, n, p, md5(array_to_string(w[p:p + n - 1], ' ')) AS h
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)
),
found AS (SELECT doc_id, item_id, p, n FROM places JOIN wanted USING (n, h)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

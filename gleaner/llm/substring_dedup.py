"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words of one document. Take a set of residues
modulo a period such that every difference is a difference of two members (a
difference cover). Of two equal windows, wherever they begin, some offset below the
period then brings both to residues of the cover. So hashing shorter runs of words,
*anchors*, at cover positions alone (6 of 31 for 50 words) is enough: equal windows
share an anchor at that offset. Shared anchors are then extended: every window
around one is compared over its whole length, by 128 bits.

Steps: whole texts that are copies; anchors of all other texts; those found in two documents or more; the windows around
them; the first document of each window; the cut texts. Counts and firsts are
map-side combined aggregates, and the joins back are plain equi-joins that adaptive
execution splits, so one passage in a third of all documents is spread over tasks.

Defined results: a null text has no words. A null id is in no order: its document is
returned whole and removes nothing. Rows that repeat an id stay rows; an id is not
smaller than itself. Extra columns are kept by ``cut_repeats`` whatever their names. An
empty table gives an empty result. A text is worked on as a whole, in arrays of about
ten bytes for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.llm.storage import Shelf

WINDOW = 50

# Perfect difference sets, by period.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
}


def period_for(window: int) -> int:
    """Largest period that leaves anchors of at least a third of the window."""
    return max(p for p in COVERS if p == 1 or 3 * (window - p + 1) >= window)


def _anchor_rows(window: int):
    period = period_for(window)
    length = window - period + 1
    covered = np.zeros(period, dtype=bool)
    covered[list(COVERS[period])] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch["text"]):
                ids = batch["doc_id"].slice(block.row, block.rows)
                at = block.window_starts(length)
                rows = block.row_of_words()[at]
                place = at - block.first[rows]
                wanted = covered[place % period] & (block.counts()[rows] >= window)
                at, rows, place = at[wanted], rows[wanted], place[wanted]
                hashes = words.window_hashes(block.word_hashes(), at, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), ids.take(pa.array(rows)), pa.array(place.astype(np.int32))],
                    names=["anchor", "doc_id", "at"],
                )

    return scan


def _window_rows(window: int):
    reach = period_for(window) - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["anchors"]
            for block in words.blocks(batch["text"]):
                ids = batch["doc_id"].slice(block.row, block.rows)
                own = lists.slice(block.row, block.rows)
                at = own.flatten().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(block.rows), own.value_lengths().to_numpy(zero_copy_only=False))
                fits = at < block.counts()[rows]  # a repeated id may bring another text's places
                at, rows = at[fits], rows[fits]
                marks = np.zeros(len(block.starts) + 1, dtype=np.int64)
                np.add.at(marks, block.first[rows] + np.maximum(at - reach, 0), 1)
                np.add.at(marks, block.first[rows] + at + 1, -1)
                starts = block.window_starts(window)
                starts = starts[np.cumsum(marks)[starts] > 0]
                rows = block.row_of_words()[starts]
                place = (starts - block.first[rows]).astype(np.int32)
                keys = [words.window_hashes(block.word_hashes(kind), starts, window, kind).view(np.int64) for kind in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[0]), pa.array(keys[1]), ids.take(pa.array(rows)), pa.array(place)],
                    names=["k1", "k2", "doc_id", "at"],
                )

    return scan


def copies_of_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key) of the rows whose whole text a smaller id has too."""
    keyed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(1), "text").alias("second_key")
    )
    firsts = (
        keyed.groupBy("text_key", "second_key")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("text_key", "second_key", "first")
    )
    return keyed.join(firsts, ["text_key", "second_key"]).filter("doc_id > first").select("doc_id", "text_key").distinct()


def repeats(docs: DataFrame, shelf: Shelf, window: int = WINDOW) -> DataFrame:
    """What to remove, by doc_id.

    copy_keys: hashes of the texts that are copies as a whole, of which the steps below
    need not see a word. repeats: windows as ``at << 32 | low bits of the hash``.
    """
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    copies = shelf.put("copies", copies_of_texts(texts))
    own_key = F.xxhash64("text").alias("text_key")
    own = texts.withColumn("text_key", own_key).join(copies, ["doc_id", "text_key"], "left_anti").select("doc_id", "text")
    anchors = shelf.put("anchors", own.mapInArrow(_anchor_rows(window), "anchor long, doc_id long, at int"))
    shared = shelf.put(
        "shared",
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("anchor"),
    )
    places = shelf.put("places", anchors.join(shared, "anchor", "left_semi").select("doc_id", "at"))
    shelf.drop("anchors", "shared")

    by_doc = places.groupBy("doc_id").agg(F.collect_list("at").alias("anchors"))
    candidates = (
        texts.join(by_doc, "doc_id")
        .select("doc_id", "text", "anchors")
        .mapInArrow(_window_rows(window), "k1 long, k2 long, doc_id long, at int")
    )
    windows = shelf.put("windows", candidates)
    shelf.drop("places")

    firsts = shelf.put(
        "firsts",
        windows.groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .drop("last"),
    )
    low_bits = F.col("k1").bitwiseAND(F.lit(0xFFFFFFFF))
    packed = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(low_bits)
    removed = windows.join(firsts, ["k1", "k2"]).filter("doc_id > first").select("doc_id", packed.alias("packed"))
    both = removed.withColumn("text_key", F.lit(None).cast("long")).unionByName(
        copies.withColumn("packed", F.lit(None).cast("long"))
    )
    grouped = both.groupBy("doc_id").agg(
        F.collect_list("packed").alias("repeats"), F.collect_set("text_key").alias("copy_keys")
    )
    out = shelf.put("removed", grouped)
    shelf.drop("windows", "firsts")
    return out


def removed_words(block: words.Block, lists: pa.Array, copies: pa.Array, window: int) -> np.ndarray:
    """A flag for each word of a block: covered by a window to remove, or in a text that is a copy."""
    marks = np.zeros(len(block.starts) + 1, dtype=np.int64)
    packed = lists.flatten().to_numpy(zero_copy_only=False)
    if len(packed):
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(block.rows), lengths)
        at, low = packed >> 32, packed & 0xFFFFFFFF
        fits = at + window <= block.counts()[rows]
        at, low, rows = at[fits], low[fits], rows[fits]
        starts = block.first[rows] + at
        own = words.window_hashes(block.word_hashes(), starts, window).view(np.int64) & 0xFFFFFFFF
        starts = starts[own == low]
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + window, -1)
    whole = copies.fill_null(False).to_numpy(zero_copy_only=False) & (block.counts() >= window)
    return (np.cumsum(marks)[:-1] > 0) | np.repeat(whole, block.counts())


def _with_repeats(docs: DataFrame, shelf: Shelf, window: int) -> DataFrame:
    """(row, repeats, is_copy): each row whole, as a struct, so that no name of its columns meets ours."""
    found = repeats(docs, shelf, window).withColumnRenamed("doc_id", "of_doc")
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("own_key"),
    )
    is_copy = F.array_contains("copy_keys", F.col("own_key")).alias("is_copy")
    return rows.join(found, rows["id"] == found["of_doc"], "left").select("row", "repeats", is_copy)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    shelf = Shelf(docs.sparkSession, "substring-dedup")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch["text"]):
                own = batch.slice(block.row, block.rows)
                gone = removed_words(block, own["repeats"], own["is_copy"], window)
                total = np.concatenate(([0], np.cumsum(gone)))[block.first]
                shas = [
                    hashlib.sha256(words.kept_text(block, row, ~gone[block.first[row] : block.first[row + 1]])).hexdigest()
                    for row in range(block.rows)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(block.row, block.rows), pa.array(block.counts()), pa.array(np.diff(total)), pa.array(shas)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    joined = _with_repeats(docs.select("doc_id", "text"), shelf, window).select("row.*", "repeats", "is_copy")
    return joined.mapInArrow(scan, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without their repeated words; those left without a word are dropped.

    An untouched text stays as it is, white space included. Of a cut text the kept
    runs of words stay as they were written, joined by a line break.
    """
    shelf = Shelf(docs.sparkSession, "substring-dedup")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array, copies: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for block in words.blocks(texts):
            gone = removed_words(
                block, lists.slice(block.row, block.rows), copies.slice(block.row, block.rows), window
            )
            for row in range(block.rows):
                lo, hi = block.first[row], block.first[row + 1]
                if lo == hi or gone[lo:hi].all():
                    out.append(None)
                elif not gone[lo:hi].any():
                    out.append(block.text(row).decode())
                else:
                    edge = np.diff(np.concatenate(([0], ~gone[lo:hi], [0])).astype(np.int8))
                    first, last = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) - 1 + lo
                    runs = zip(block.starts[first].tolist(), block.ends[last].tolist(), strict=True)
                    out.append(b"\n".join([block.data[a:b].tobytes() for a, b in runs]).decode())
        return pa.array(out, pa.string())

    joined = _with_repeats(docs, shelf, window)
    whole = joined.select("row", cut(F.col("row.text"), F.col("repeats"), F.col("is_copy")).alias("kept"))
    return whole.filter(F.col("kept").isNotNull()).select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM w WHERE len(w) >= {WINDOW})
),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > first),
spelled AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
    FROM spelled s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.p = s.p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

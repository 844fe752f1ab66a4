"""Suffix-array dedup: suffixes ordered by radix passes, only through the threshold.

A suffix array over all texts, sorted to depth ``window`` alone, has the equal groups of
that sort as exactly the repeated windows. Sorting most significant digit first lets a
suffix leave as soon as no other one agrees with it, and nearly all leave at once.
Here the first digit of a window is its *anchor*: of the 32-byte runs inside the window
the one with the least 32 bits of hash (the leftmost of equals). It depends on the window's
bytes alone, so equal windows have equal anchors at equal offsets; and neighbouring
windows mostly share one, so this pass costs one row for about 30 suffixes. Suffixes
whose anchor occurs once are finished.

The others are grouped by anchor and offset, and sorted inside each group by the bytes
of their windows, most significant digit first, a digit being eight bytes. A pass orders
the suffixes of every bucket by their digit, counts the new buckets, and lets those go
that are alone in theirs. The runs left equal after the last pass are the repeated
windows: the first of each, by (doc_id, start), stays and the others go.

An anchor may be part of a passage of a third of all documents. Its places are dealt by
salt into blocks of about ``block_rows``, each sorted as any other group; then the
blocks are merged: of every window the first place of each block, a row, meets those
of the other blocks under 128 bits of its bytes, and map-side combined minimums keep
the first of all. An anchor with fewer places is one block and has nothing to merge.

Documents that are copies as a whole are settled before by their hash.

Defined results: a null text is empty. A null id is in no order: its document is
returned whole and removes nothing. Rows that repeat an id are one document with
several texts; equal places of them are one place. An empty table gives no rows. Other
columns, whatever their names, are not read. A text is a unit of memory: a task needs
about a hundred times the size of its longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.llm.groups import edges_of, numbers, whole_groups
from gleaner.llm.storage import Shelf
from gleaner.llm.substring_dedup import copies_of_texts

WINDOW = 100
ANCHOR = 32
DIGIT = 8
CHECKED = 25  # bytes by which a place is known again
BLOCK_ROWS = 20_000  # of about 150 bytes: what one task holds at once
TABLE_ROWS = 6_000
FIRST_ROWS = 1 << 16
HIGH_HALF = np.uint64(0xFFFFFFFF00000000)

CONTEXTS = "anchor long, doc_id long, at int, low int, context binary, blocks int"
SORTED = "doc_id long, packed long, length int, k1 long, k2 long"
BLOCK_BITS = 24


def _anchors(data: np.ndarray, edges: np.ndarray, window: int, size: int) -> tuple[np.ndarray, ...]:
    """(row, at, low, high, hash): anchors in bytes of the block, and the windows low..high that have them."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < window:
        return none, none, none, none, none.astype(np.uint64)
    hashes = words.every_byte_hash(data, size)
    # High half of the hash, then the place: the least one is the leftmost of the least hashes.
    least = (hashes & HIGH_HALF) | np.arange(len(hashes), dtype=np.uint64)
    wanted, span = window - size + 1, 1
    while span < wanted:
        step = min(span, wanted - span)
        least = np.minimum(least[step:], least[:-step])
        span += step
    changes = np.ones(len(least) + 1, dtype=bool)
    np.not_equal(least[1:], least[:-1], out=changes[1:-1])
    stops = edges[1:][np.diff(edges) >= window] - window + 1  # the first window that leaves its row
    for cuts in (edges, stops):
        changes[cuts[cuts < len(changes)]] = True
    runs = np.flatnonzero(changes)
    first, last = runs[:-1], runs[1:] - 1
    row = np.searchsorted(edges, first, side="right") - 1
    fits = first + window <= edges[row + 1]
    row, first, last = row[fits], first[fits], last[fits]
    place = (least[first] & ~HIGH_HALF).astype(np.int64)
    return row, place, first, last, hashes[place]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    data, edges = words.text_buffer(batch["text"])
    for row, stop in words.row_blocks(edges):
        yield batch.slice(row, stop - row), data[edges[row] : edges[stop]], edges[row : stop + 1] - edges[row]


def _anchor_rows(window: int, size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, edges in _blocks(batch):
                row, at, _, _, hashes = _anchors(data, edges, window, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        own["doc_id"].take(pa.array(row)),
                        pa.array((at - edges[row]).astype(np.int32)),
                    ],
                    names=["anchor", "doc_id", "at"],
                )

    return scan


def _context_rows(window: int, size: int):
    """The anchors that others share, each with the bytes of its windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, edges in _blocks(batch):
                row, at, low, high, hashes = _anchors(data, edges, window, size)
                lists = own["places"]
                listed = lists.flatten().to_numpy(zero_copy_only=False)
                of_row = np.repeat(np.arange(own.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                key = (row << 32) + at - edges[row]
                known = (of_row << 32) + (listed >> BLOCK_BITS)
                order = np.argsort(known)
                known, blocks = known[order], (listed & (1 << BLOCK_BITS) - 1)[order]
                found = np.searchsorted(known, key)
                shared = np.append(known, -1)[found] == key
                row, at, low, high, hashes, found = (x[shared] for x in (row, at, low, high, hashes, found))
                lengths = high - low + window
                ends = np.cumsum(lengths)
                take = np.repeat(low - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                context = pa.BinaryArray.from_buffers(
                    pa.binary(), len(low), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[take]))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        own["doc_id"].take(pa.array(row)),
                        pa.array((at - edges[row]).astype(np.int32)),
                        pa.array((low - edges[row]).astype(np.int32)),
                        context,
                        pa.array(blocks[found].astype(np.int32)),
                    ],
                    names=["anchor", "doc_id", "at", "low", "context", "blocks"],
                )

    return scan


_COLUMNS = ["doc_id", "packed", "length", "k1", "k2"]


class _Suffixes:
    """The windows of a table of contexts: row, place in the bytes, and start in the document."""

    def __init__(self, table: pa.Table, window: int):
        column = pa.concat_arrays(table["context"].chunks)
        data, edges = words.text_buffer(column)
        self.data, edges = data[edges[0] : edges[-1]], edges - edges[0]
        counts = np.diff(edges) - window + 1
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.row)) + np.repeat(edges[:-1] - (np.cumsum(counts) - counts), counts)
        self.doc, self.at, low = numbers(table, "doc_id", "at", "low")
        self.start = low[self.row] + self.place - edges[self.row]
        self.window, self.checked = window, min(CHECKED, window)

    def checks(self, which: np.ndarray) -> np.ndarray:
        """Start and 32 bits of the first bytes: enough to know the place again in the right text."""
        at = self.place[which]
        low = words.byte_hashes(self.data, at, at + self.checked).view(np.int64) & 0xFFFFFFFF
        return (self.start[which].astype(np.int64) << 32) | low

    def ordered(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes whose window another one of their block has, in the order of block, offset and bytes, and
        where each run of equal windows begins. block: of each row, ascending. Equal windows keep the order of rows.
        """
        size = min(DIGIT, self.window)
        padded = np.concatenate((self.data, np.zeros(DIGIT, dtype=np.uint8)))
        digits = np.lib.stride_tricks.sliding_window_view(padded, DIGIT)[: len(self.data)]
        digits = np.ascontiguousarray(digits).view(">u8").reshape(-1).astype(np.uint64) >> np.uint64(8 * (DIGIT - size))
        offset = self.at[self.row] - self.start
        live = np.lexsort((offset, block[self.row]))
        live, begins = _together(live, edges_of(block[self.row[live]], offset[live]))
        for skip in [*range(0, self.window - size, size), self.window - size]:
            sizes = np.diff(begins)
            digit = digits[self.place[live] + skip]
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            differs = np.append(False, (digit[1:] != digit[:-1]) & (bucket[1:] == bucket[:-1]))
            if not differs.any():
                continue
            apart = np.flatnonzero(np.repeat(np.add.reduceat(differs, begins[:-1], dtype=np.int64) > 0, sizes))
            inside = apart[np.lexsort((digit[apart], bucket[apart]))]
            live[apart], digit[apart] = live[inside], digit[inside]
            live, begins = _together(live, edges_of(bucket, digit))
        return live, begins

    def firsts(self, which: np.ndarray) -> pa.RecordBatch:
        """The first places of windows in a block, for the merge."""
        at = self.place[which]
        keys = [words.span_hashes(self.data, at, at + self.window, kind).view(np.int64) for kind in (0, 1)]
        doc, length = pa.array(self.doc[self.row[which]]), pa.array(np.full(len(which), self.window, dtype=np.int32))
        return pa.RecordBatch.from_arrays([doc, pa.array(self.checks(which)), length, *map(pa.array, keys)], names=_COLUMNS)

    def spans(self, which: np.ndarray) -> pa.RecordBatch:
        """Runs of consecutive windows of a row, as (doc_id, packed, length). which: ascending."""
        row, place = self.row[which], self.place[which]
        runs = edges_of(row, place - np.arange(len(place)))
        first, last = runs[:-1], runs[1:] - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.doc[row[first]]),
                pa.array(self.checks(which[first])),
                pa.array((place[last] - place[first] + self.window).astype(np.int32)),
                *[pa.nulls(len(first), pa.int64())] * 2,
            ],
            names=_COLUMNS,
        )


def _together(order: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of buckets of two or more, and where each of these buckets begins, and the end."""
    sizes = np.diff(begins)
    several = sizes > 1
    return order[np.repeat(several, sizes)], np.concatenate(([0], np.cumsum(sizes[several])))


def _radix(window: int):
    """Later places of every window of a block, and the first places in blocks that others share an anchor with.

    The rows come by (anchor, salt, doc_id, at).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["anchor", "salt"], TABLE_ROWS):
            suffixes = _Suffixes(table, window)
            anchor, salt, blocks = numbers(table, "anchor", "salt", "blocks")
            edges = edges_of(anchor, salt)
            live, begins = suffixes.ordered(np.repeat(np.arange(len(edges) - 1), np.diff(edges)))
            first = np.repeat(live[begins[:-1]], np.diff(begins))
            doc, start = suffixes.doc[suffixes.row], suffixes.start
            later = live[(doc[live] != doc[first]) | (start[live] != start[first])]
            if len(later):
                yield suffixes.spans(np.sort(later))
            ahead = blocks[suffixes.row] > 1
            ahead[later] = False
            ahead = np.flatnonzero(ahead)
            for begin in range(0, len(ahead), FIRST_ROWS):
                yield suffixes.firsts(ahead[begin : begin + FIRST_ROWS])

    return scan


def repeated_spans(docs: DataFrame, shelf: Shelf, window: int, anchor: int, block_rows: int) -> DataFrame:
    """(doc_id, spans, copy_keys): what to remove of each document."""
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    copies = shelf.put("copies", copies_of_texts(texts))
    own_key = F.xxhash64("text").alias("text_key")
    own = texts.withColumn("text_key", own_key).join(copies, ["doc_id", "text_key"], "left_anti").select("doc_id", "text")
    anchors = shelf.put("anchors", own.mapInArrow(_anchor_rows(window, anchor), "anchor long, doc_id long, at int"))
    shared = shelf.put(
        "shared",
        anchors.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("found"))
        .filter("found > 1")
        .select("anchor", F.ceil(F.col("found") / block_rows).alias("blocks")),
    )
    marked = (F.shiftleft(F.col("at").cast("long"), BLOCK_BITS) + F.col("blocks")).alias("place")
    places = shelf.put("places", anchors.join(shared, "anchor").select("doc_id", marked))
    shelf.drop("anchors", "shared")

    by_doc = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    found = texts.join(by_doc, "doc_id").select("doc_id", "text", "places")
    contexts = shelf.put("contexts", found.mapInArrow(_context_rows(window, anchor), CONTEXTS))
    shelf.drop("places")

    dealt = contexts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), "blocks").cast("int"))
    dealt = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id", "at")
    ordered = shelf.put("sorted", dealt.mapInArrow(_radix(window), SORTED))
    shelf.drop("contexts")
    ahead = ordered.filter("k1 IS NOT NULL")
    place = F.struct("doc_id", F.shiftright("packed", 32).alias("start"))
    firsts = shelf.put("firsts", ahead.groupBy("k1", "k2").agg(F.min(place).alias("first")))
    later = ahead.join(firsts, ["k1", "k2"]).filter(place != F.col("first"))
    every = ordered.filter("k1 IS NULL").select("doc_id", "packed", "length").unionByName(later.select("doc_id", "packed", "length"))

    both = every.select("doc_id", F.struct("packed", "length").alias("span"), F.lit(None).cast("long").alias("text_key"))
    copied = copies.select("doc_id", F.lit(None).cast("struct<packed:bigint,length:int>").alias("span"), "text_key")
    grouped = both.unionByName(copied).groupBy("doc_id")
    out = shelf.put(
        "removed", grouped.agg(F.collect_list("span").alias("spans"), F.collect_set("text_key").alias("copy_keys"))
    )
    shelf.drop("sorted", "firsts")
    return out


def removed_bytes(own: pa.RecordBatch, data: np.ndarray, edges: np.ndarray, window: int) -> np.ndarray:
    """A flag for each byte of a block of texts."""
    marks = np.zeros(len(data) + 1, dtype=np.int64)
    spans = own["_spans"]
    flat = spans.flatten()
    lengths = np.diff(edges)
    if len(flat):
        row = np.repeat(np.arange(own.num_rows), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        packed, length = flat.field("packed").to_numpy(), flat.field("length").to_numpy()
        start = packed >> 32
        fits = start + length <= lengths[row]
        row, start, length, packed = row[fits], start[fits] + edges[row[fits]], length[fits], packed[fits]
        same = words.byte_hashes(data, start, start + min(CHECKED, window)).view(np.int64) & 0xFFFFFFFF == packed & 0xFFFFFFFF
        np.add.at(marks, start[same], 1)
        np.add.at(marks, start[same] + length[same], -1)
    whole = own["_is_copy"].fill_null(False).to_numpy(zero_copy_only=False) & (lengths >= window)
    return (np.cumsum(marks)[:-1] > 0) | np.repeat(whole, lengths)


def digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    shelf = Shelf(docs.sparkSession, "suffix-dedup")
    found = repeated_spans(docs, shelf, window, min(anchor, window), block_rows).select(
        F.col("doc_id").alias("_of_doc"), F.col("spans").alias("_spans"), F.col("copy_keys").alias("_copy_keys")
    )
    texts = docs.select("doc_id", "text")
    is_copy = F.array_contains("_copy_keys", F.xxhash64("text")).alias("_is_copy")
    joined = texts.join(found, texts["doc_id"] == found["_of_doc"], "left").select("doc_id", "text", "_spans", is_copy)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, edges in _blocks(batch):
                gone = removed_bytes(own, data, edges, window)
                total = np.concatenate(([0], np.cumsum(gone)))
                before = np.concatenate(([False], gone[:-1]))
                before[edges[:-1][edges[:-1] < len(gone)]] = False
                begun = np.concatenate(([0], np.cumsum(gone & ~before)))
                shas = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    kept = data[a:b] if total[a] == total[b] else data[a:b][~gone[a:b]]
                    shas.append(hashlib.sha256(kept.tobytes()).hexdigest())
                counts = [np.diff(edges), np.diff(total[edges]), np.diff(begun[edges])]
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], *[pa.array(x) for x in counts], pa.array(shas)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return joined.mapInArrow(scan, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
